"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes one symbol for each character, and an agenda of adjacent symbol pairs, ordered by the score of the
merged piece and then from left to right, says which pair is merged next. No piece of such a vocabulary holds a word
mark behind another character, so no merge crosses the start of a word; nor does one cross a line end that stands in no
piece. A text is cut there, and each distinct part goes through the agenda once per worker while it is remembered (the
memory is bounded in parts and in bytes, and keeps what was used last). A vocabulary with a piece that breaks the first
rule is handled by one agenda over the whole text. The parts of an Arrow batch that went through the agenda (without
word starts: its texts) are checked against the sentencepiece library together; where the two differ the library's ids
are taken, and the text is marked in column agrees. Then the ids of each whole text are decoded, by the library for a
batch of texts at once and by the pieces of the parts; where the two differ the library's text is taken, and agrees is
false as well.

Defined cases: a null or empty text has no ids and decodes to the empty text; a null doc_id is kept; repeated rows are
encoded each; other columns of the input are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

MARK = "▁"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean, agrees boolean"
REMEMBERED_PARTS = 400_000
REMEMBERED_BYTES = 96 << 20


class Codec:
    """Encoder and decoder over the vocabulary of a model file."""

    def __init__(self, model: str, remembered: int = REMEMBERED_PARTS, remembered_bytes: int = REMEMBERED_BYTES) -> None:
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.byte_of: dict[int, int] = {}
        self.text_of: dict[int, str] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_of[i] = value = int(piece[3:5], 16)
                self.byte_id[value] = i
            elif sp.is_unknown(i):
                self.text_of[i] = " ⁇ "  # what the library writes for an unknown id
            elif sp.is_control(i):
                self.text_of[i] = ""
            else:
                self.id[piece], self.score[piece] = i, sp.get_score(i)
                self.text_of[i] = piece.replace(MARK, " ")
        self.unknown = sp.unk_id()
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id)
        self.line_alone = not any("\n" in p for p in self.id)
        self.known: dict[str, str] = {}  # part -> its ids, joined
        self.older: dict[str, str] = {}
        self.strange: dict[str, str] = {}  # of those, the ones that decode to something else than themselves
        self.fresh: list[str] = []  # parts that the library hasn't checked yet
        self.limit, self.most_bytes = remembered, remembered_bytes
        self.held = 0  # bytes of known

    def word(self, word: str) -> list[int]:
        """Ids of a text that starts with its word mark, by the agenda of adjacent pairs."""
        score, piece = self.score, list(word)
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            s = score.get(piece[i] + piece[i + 1])
            if s is not None:
                agenda.append((-s, i, i + 1, len(piece[i]) + len(piece[i + 1])))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not piece[i] or not piece[j] or after[i] != j or len(piece[i]) + len(piece[j]) != size:
                continue
            piece[i] += piece[j]
            piece[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := score.get(merged := piece[i] + piece[k])) is not None:
                    heapq.heappush(agenda, (-s, i, k, len(merged)))
            if (h := before[i]) >= 0 and (s := score.get(merged := piece[h] + piece[i])) is not None:
                heapq.heappush(agenda, (-s, h, i, len(merged)))
        ids = []
        for p in piece:
            if p:
                i = self.id.get(p)
                if i is not None:
                    ids.append(i)
                elif self.byte_id:
                    ids += [self.byte_id[b] for b in p.encode()]
                else:
                    ids.append(self.unknown)
        return ids

    def _part(self, part: str) -> str:
        """The ids of a part that isn't in known, joined; it is there afterwards."""
        if (len(self.known) >= self.limit or self.held >= self.most_bytes) and not self.fresh:
            self.older, self.known, self.held = self.known, {}, 0
            self.strange = {k: v for k, v in self.strange.items() if k in self.older}
        said = self.older.get(part)
        if said is None:
            marked = self.marked(part)
            ids = self.word(marked)
            said = ",".join(map(str, ids))
            self.fresh.append(part)
            self._note(part, marked, ids)
        self.known[part] = said
        self.held += sys.getsizeof(part) + sys.getsizeof(said)
        return said

    def _note(self, part: str, marked: str, ids: list[int]) -> None:
        if (text := self.pieces(ids)) != marked.replace(MARK, " "):
            self.strange[part] = text
        else:
            self.strange.pop(part, None)

    @staticmethod
    def marked(part: str) -> str:
        """A part as the agenda sees it: one that starts with a line end or with marks is as it stands, others get a mark."""
        return part if part[:1] in ("\n", MARK) else MARK + part

    def parts(self, text: str) -> list[str]:
        """text cut where no merge can cross; a single leading mark is left out."""
        cut = text.replace("\n", " \n") if self.line_alone else text
        found = cut.split(" ")
        if "" not in found and MARK not in text and (self.line_alone or "\n" not in text) and text[0] != "\n":
            return found
        line = "\n" if self.line_alone else ""
        found = re.findall(f"{MARK}+[^{MARK}{line}]*" + (f"|\n[^{MARK}\n]*" if line else ""), MARK + text.replace(" ", MARK))
        return [p[1:] if p[0] == MARK and p[1:2] not in ("\n", MARK, "") else p for p in found]

    def check(self) -> set[str]:
        """Hold the fresh parts against the library; returns those on which the two differed, which then have its ids."""
        # the library puts a mark before a text: a part without one loses those ids again, a lone mark gets a line end behind it
        fresh = [p for p in self.fresh if p != MARK or self.line_alone]
        theirs = self.library.encode([p if p[0] == "\n" else "\n" if p == MARK else self.marked(p)[1:].replace(MARK, " ") for p in fresh], num_threads=1)
        head, end = len(self.word(MARK)), len(self.word("\n"))
        odd = set()
        for part, ids in zip(fresh, theirs):
            ids = ids[head:] if part[0] == "\n" else ids[:-end] if part == MARK else ids
            if (said := ",".join(map(str, ids))) != self.known[part]:
                odd.add(part)
                self.known[part] = said
                self._note(part, self.marked(part), ids)
        self.fresh.clear()
        return odd

    def encode_text(self, text: str) -> str:
        """The decimal ids of a text, joined by commas."""
        if not text:
            return ""
        if not self.by_word:
            return ",".join(map(str, self.word(MARK + text.replace(" ", MARK))))
        parts = self.parts(text)
        found = list(map(self.known.get, parts))
        if None in found:
            found = [self._part(p) if f is None else f for p, f in zip(parts, found)]
        return ",".join(found)

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_text(text).split(",") if x]

    def check_texts(self, texts: list[str], found: list[str]) -> set[str]:
        """As check(), for a vocabulary without word starts: whole texts, whose ids in found are put right."""
        odd = set()
        for i, ids in enumerate(self.library.encode(texts, num_threads=1)):
            if (said := ",".join(map(str, ids))) != found[i]:
                odd.add(texts[i])
                found[i] = said
        return odd

    def decoded_text(self, text: str, ids: list[int]) -> str:
        """What the ids of text, as encode_text gave them, decode to."""
        if not self.by_word:
            return self.decode(ids)
        if self.strange and not self.strange.keys().isdisjoint(parts := self.parts(text) if text else []):
            whole = "".join(self.strange[p] if p in self.strange else self.marked(p).replace(MARK, " ") for p in parts)
            return whole[1:] if whole[:1] == " " else whole
        return text.replace(MARK, " ")

    def pieces(self, ids: list[int]) -> str:
        """The pieces of ids as text, runs of byte pieces read as UTF-8."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join(map(self.text_of.__getitem__, ids))
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            out.append(self.text_of[i])
        return "".join(out) + _utf8(bytes(run))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks become spaces, and the first one goes."""
        text = self.pieces(ids)
        return text[1:] if text[:1] == " " and ids[0] not in self.byte_of else text


def _utf8(run: bytes) -> str:
    """Bytes as text, with one replacement character for each byte that starts no valid character."""
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[i : i + n].decode())
            except UnicodeDecodeError:
                continue
            i += n
            break
        else:
            out.append("�")
            i += 1
    return "".join(out)


def numbers(found: list[str]) -> list[list[int]]:
    """Ids joined by commas, as lists."""
    cut = pc.split_pattern(pa.array([f or None for f in found], pa.large_string()), ",")
    flat = pc.cast(pc.list_flatten(cut), pa.int32()).to_numpy(zero_copy_only=False)
    ends = pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False).cumsum().tolist()
    return [flat[a:b].tolist() for a, b in zip([0, *ends], ends)]


@functools.lru_cache(2)
def codec_of(model: str) -> Codec:
    """One codec for each worker process, so that later tasks find its words."""
    return Codec(model)


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """One row for each row of docs(doc_id, text): SCHEMA."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = list(map(codec.encode_text, texts))
            if codec.by_word:
                parts = codec.check()
                odd = {t for t in texts if t and not parts.isdisjoint(codec.parts(t))} if parts else set()
                found = [codec.encode_text(t) if t in odd else f for t, f in zip(texts, found)] if odd else found
            else:
                odd = codec.check_texts(texts, found)
            lists = numbers(found)
            rows = []
            for text, joined, ids, decoded in zip(texts, found, lists, codec.library.decode(lists, num_threads=1)):
                agrees = text not in odd and codec.decoded_text(text, ids) == decoded
                rows.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded == text, agrees))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.bool_()), pa.array(columns[4], pa.bool_())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "agrees"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
