"""Prompt messages as arrays of struct(role, content), content an array of struct(type, text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

CONTENT = "array<struct<type:string,text:string>>"
PLAIN = "{{ content }}"


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _words(s: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), s.alias("text"))).cast(CONTENT)


def system_prompt(question: Column, system: str = "", template: str = PLAIN) -> Column:
    """A system message, and the question through the template with its images in place."""
    user = _message("user", text.message_parts(text.render(question, template)).cast(CONTENT))
    return F.array(_message("system", _words(F.lit(system))), user) if system else F.array(user)


def user_prompt(question: Column, template: str = PLAIN) -> Column:
    return system_prompt(question, "", template)


def with_image(question: Column, template: str = PLAIN) -> Column:
    """The question behind an image marker, for rows whose text has none."""
    return user_prompt(F.concat(F.lit(text.IMAGE + "\n"), question), template)


#: How each kind of row becomes messages: (question, template) -> messages.
BUILDERS: dict[str, Callable[..., Column]] = {
    "system": system_prompt,
    "grounding": user_prompt,
    "user": user_prompt,
    "validation": user_prompt,
    "math": with_image,
    "mathdata": with_image,
}


def messages(kind: Column, question: Column, templates: dict[str, str]) -> Column:
    """Messages by the kind of each row; kinds without a template take the question as it is."""
    case = None
    for name, build in BUILDERS.items():
        said = build(question, template=templates.get(name, PLAIN))
        case = F.when(kind == name, said) if case is None else case.when(kind == name, said)
    return case.otherwise(user_prompt(question))


def vision_content(images: Column, question: Column) -> Column:
    """Images by their data URL first, the text last."""
    shown = F.transform(images, lambda u: F.struct(F.lit("image_url").alias("type"), u.alias("text")))
    return F.concat(shown.cast(CONTENT), _words(question))
