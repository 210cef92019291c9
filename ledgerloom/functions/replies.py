"""JSON in the replies of models: fenced, cut off or with slips, read as far as it is valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_text(c: Column) -> Column:
    """From the first `[` to the last `]` of a reply without its fences; null if there is none."""
    bare = F.regexp_replace(F.replace(F.replace(c, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")), r"^\s+|\s+$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), F.lit(""))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and no more. The reader stops after a value, so the text is tried as an element and as a field: nothing but a
    single value can be both."""
    tried = lambda a, b: F.try_parse_json(F.concat(F.lit(a), text, F.lit(b))).isNotNull()
    return F.coalesce(tried("[", "]") & tried('{"v": ', "}") & (F.trim(text) != ""), F.lit(False))


def rows(c: Column) -> Column:
    """array<map<string,string>>: the objects of a reply's array. Empty for a reply without an array and for one that is not valid JSON as a whole:
    what is left of an array that was cut off is not guessed."""
    text = array_text(c)
    valid = is_json(text)
    none = F.array().cast("array<map<string,string>>")
    return F.coalesce(F.when(valid, F.from_json(text, "array<map<string,string>>")), none)


def object_text(c: Column) -> Column:
    """The object of a reply as JSON: fences and what stands around the braces go, as do commas before closing brackets; Python's words are JSON's,
    and braces that were not closed are."""
    text = F.regexp_replace(F.regexp_replace(c, r"```(?:json)?", ""), r"^\s+|\s+$", "")
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    backward = F.contains(text, F.lit("{")) & F.contains(text, F.lit("}"))
    text = F.when(inner != "", inner).when(backward, "").otherwise(text)
    text = F.regexp_replace(text, r",\s*([\]}])", "$1")
    for word, said in (("True", "true"), ("False", "false"), ("None", "null")):
        text = F.regexp_replace(text, rf":\s*{word}\b", f": {said}")
    count = lambda mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    return F.concat(text, F.repeat(F.lit("}"), F.greatest(F.lit(0), count("{") - count("}"))))


def object_of(c: Column) -> Column:
    """struct(state, json): read, invalid (braces, but no JSON) or missing."""
    text = object_text(c)
    valid = is_json(text)
    state = F.when(valid, "read").when(c.rlike(r"(?s)\{.*\}"), "invalid").otherwise("missing")
    return F.struct(state.alias("state"), F.when(valid, text).alias("json"))
