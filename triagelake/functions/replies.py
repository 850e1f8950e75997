"""Reading the JSON answer inside a free-text reply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagelake.schemas import RESULT


def braced_part(text: Column) -> Column:
    """From the first ``{`` to the last ``}``, across lines; NULL without such a pair."""
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + F.lit(1)
    found = (first > F.lit(0)) & F.contains(text, F.lit("}")) & (last > first)
    return F.when(found, F.substring(text, first, last - first + F.lit(1)))


def is_json_object(text: Column) -> Column:
    """The whole text, which starts with a brace, is one JSON object with at least one key.

    The parsers stop after the first value, so the text is read as the element of a list and
    as the value of a field: whatever follows the object breaks one of the two.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    field = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    empty = F.rlike(text, F.lit(r"^\{\s*\}$"))
    return listed.isNotNull() & field.isNotNull() & ~empty


def answer_of(json: Column) -> Column:
    return F.from_json(json, RESULT.simpleString())
