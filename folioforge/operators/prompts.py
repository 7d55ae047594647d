"""Prompts: templates compiled to column expressions, budgets in tokens, and the fixed question prompt."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions import tokens

#: The suffix of a shortened text, and separators.
TRUNCATED = "\n... [TRUNCATED DUE TO CONTEXT LIMIT] ..."
CONTEXT_SEPARATOR = "\n---\n"

_PLACE = re.compile(r"\{\{\s*(\w+)\s*\}\}")


def question_prompt(question: Column, context: Column) -> Column:
    """The prompt of a question on a text."""
    return F.concat(F.lit("Based on the following text, answer the question: '"), question, F.lit("'.\n\nText: "), context)


def validate_template(template: str) -> bool:
    """Whether every opened place is a name and closed."""
    rest = _PLACE.sub("", template)
    return "{{" not in rest and "}}" not in rest


def render(template: str, values: Mapping[str, Column | str]) -> Column:
    """A template with its places filled; unknown names and null values give nothing; values aren't rendered again."""
    parts: list[Column] = []
    end = 0
    for m in _PLACE.finditer(template):
        parts.append(F.lit(template[end : m.start()]))
        value = values.get(m[1], "")
        parts.append(F.coalesce(value if isinstance(value, Column) else F.lit(value), F.lit("")))
        end = m.end()
    return F.concat(*parts, F.lit(template[end:]))


def compose(components: Mapping[str, str], context: Mapping[str, Column | str], document_text: Column, max_length: int, count: Callable[[Column], Column] = tokens.count, first: Callable[[Column, Column], Column] = tokens.first) -> Column:
    """The task's prompt with the document's text, shortened to what the budget leaves.

    The budget is ``max_length`` less the tokens of the frame with an empty text. A longer text keeps its first tokens
    and gets a suffix, which isn't counted. A negative budget takes tokens off the end. ``context`` comes before
    ``components``; there must be a component ``prompt``.
    """
    if "prompt" not in components:
        raise ValueError("the task has no component 'prompt'")
    values = {**components, **context}
    frame = render(components["prompt"], {**values, "document_text": ""})
    budget = F.lit(max_length) - count(frame)
    kept = F.when(count(document_text) > budget, F.concat(first(document_text, budget), F.lit(TRUNCATED))).otherwise(document_text)
    return render(components["prompt"], {**values, "document_text": kept})
