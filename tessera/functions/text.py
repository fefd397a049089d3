"""Column functions on text: tags, boxes, prompts, verdicts and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The media markers of prompts and the verdict header.
IMAGE, VIDEO = "<image>", "<video>"
VERDICT_HEADER = "## Equivalence Judgement"
_STRIP = r"(?U)^\s+|\s+$"


def strip(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(s, _STRIP, "")


def tidy_tags(s: Column) -> Column:
    """White space around angle brackets and slashes removed."""
    return F.regexp_replace(s, r"(?U)\s*(<|>|/)\s*", "$1")


def tag(s: Column, name: str) -> Column:
    """The stripped content of the first <name>..</name>, null without one."""
    pattern = f"(?s)<{name}>(.*?)</{name}>"
    return F.when(s.rlike(pattern), strip(F.regexp_extract(s, pattern, 1)))


def tags(s: Column, name: str) -> Column:
    """The contents of all <name>..</name>, as an array."""
    return F.regexp_extract_all(s, F.lit(f"(?s)<{name}>(.*?)</{name}>"), F.lit(1))


def count_matches(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))


def well_formed(s: Column, first: str = "think", second: str = "answer") -> Column:
    """1 if the text is <first>..</first> followed by <second>..</second> as a whole, else 0."""
    return F.coalesce(s.rlike(rf"(?s)\A<{first}>.*</{first}>.*<{second}>.*</{second}>\z"), F.lit(False)).cast("int")


def guarded(s: Column, value: Column, most: int = 1000) -> Column:
    """value, or 0 for a text longer than most."""
    return F.when(F.length(s) > most, F.lit(0)).otherwise(value)


def box(body: Column) -> Column:
    """The four whole numbers of a body that starts with [a,b,c,d], without spaces; null otherwise."""
    pattern = r"^\[(\d+),(\d+),(\d+),(\d+)\]"
    return F.when(body.rlike(pattern), F.array(*(F.regexp_extract(body, pattern, i).cast("long") for i in range(1, 5))))


def without_boxes(s: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(s, r"(?s)<box>.*?</box>", ""), r"(?U)\s+", " "))


def clean_question(s: Column) -> Column:
    return strip(F.replace(s, F.lit(IMAGE), F.lit("")))


def message_parts(s: Column, marker: str = IMAGE + "\n", kind: str = "image") -> Column:
    """A prompt cut at the marker: array of (type, text), a media part before every piece but the first; empty text left out."""
    pieces = F.split(s, rf"\Q{marker}\E", -1)
    media = F.struct(F.lit(kind).alias("type"), F.lit(None).cast("string").alias("text"))

    def part(p: Column, i: Column) -> Column:
        words = F.struct(F.lit("text").alias("type"), p.alias("text"))
        own = F.when(p != "", F.array(words)).otherwise(F.array().cast("array<struct<type:string,text:string>>"))
        return F.when(i > 0, F.concat(F.array(media), own)).otherwise(own)

    return F.flatten(F.transform(pieces, part))


def placed_texts(s: Column, marker: str = IMAGE + "\n") -> Column:
    """The text parts of message_parts as an array of (place, text): place counts the markers before the part."""
    pieces = F.transform(F.split(s, rf"\Q{marker}\E", -1), lambda p, i: F.struct(i.alias("place"), p.alias("text")))
    return F.filter(pieces, lambda x: x["text"] != "")


def render(content: Column, template: str = "{{ content }}") -> Column:
    """The template with its content variable (also with a trim filter) replaced."""
    said = template.replace("{{ content | trim }}", "\0").replace("{{ content }}", "\1").replace("{{content}}", "\1")
    parts, text = [], ""
    for c in said:
        if c in "\0\1":
            parts += [F.lit(text), strip(content) if c == "\0" else content]
            text = ""
        else:
            text += c
    return F.concat(*parts, F.lit(text))


def rename_think(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("<think>"), F.lit("<thought>")), F.lit("</think>"), F.lit("</thought>"))


def verdict(s: Column) -> Column:
    """Whether what follows the last verdict header says true and not false."""
    said = F.lower(F.element_at(F.split(s, rf"\Q{VERDICT_HEADER}\E", -1), -1))
    return said.contains("true") & ~said.contains("false")


def consistency(s: Column) -> Column:
    """A judge's score: the first of 0.0, 0.3, 0.7, 1.0, 0, 1 in the text, else its number clamped to 0..1, else null."""
    pattern = r"(0\.0|0\.3|0\.7|1\.0|0|1)"
    number = strip(s).try_cast("double")
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, 1).cast("double")).when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def join_path(directory: Column, path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.regexp_replace(directory, "/+$", ""), path))


def step_name(step: Column) -> Column:
    return F.format_string("step_%06d.json", step)


def row_tag(*parts: Column) -> Column:
    """A stable tag of a row."""
    return F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256).substr(1, 32)


def data_url(content: Column, kind: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def box_list(boxes: Column, name: str = "box") -> Column:
    """Boxes as lines: <name1> x1 y1 x2 y2."""
    return F.array_join(F.transform(boxes, lambda b, i: F.concat(F.lit(f"<{name}"), (i + 1).cast("string"), F.lit("> "), F.array_join(F.transform(b, lambda v: v.cast("string")), " "))), "\n")


def token_position(lengths: Column, at: Column) -> Column:
    """The number of tokens up to and including the first whose cumulative character length reaches at; all if none does."""
    sums = F.aggregate(lengths, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("hit")), lambda a, x: F.struct(
        (a["sum"] + x).alias("sum"), F.when(a["hit"], a["n"]).otherwise(a["n"] + 1).alias("n"), (a["hit"] | (a["sum"] + x >= at)).alias("hit")))
    return sums["n"]


def shown(x: Column) -> Column:
    """A number with three digits behind the point; very small and very large ones in scientific form."""
    return F.when((F.abs(x) >= 1e7) | ((x != 0) & (F.abs(x) < 1e-3)), F.format_string("%.3e", x)).otherwise(F.format_string("%.3f", x))
