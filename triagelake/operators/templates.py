"""Log templates as a set operation over distinct messages.

Messages with the same token count and the same leading tokens share a template; tokens
that hold a digit do not take part in the prefix. A position where the messages of a
template differ becomes a wildcard. The outcome does not depend on row order.
"""

from __future__ import annotations

import os
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.fixed_values import (
    MAX_EXAMPLES, PREFIX_TOKENS, TOKEN_DELIMITERS, TOP_TEMPLATES, WILDCARD,
)
from triagelake.mask_rules import mask_rules
from triagelake.session import cut_lineage

GENERIC_MASKS = ("ISO_TIMESTAMP", "URL", "HOST", "UID")
SPACES = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]+"
#: Common first characters from which neighbouring mask rules are tested together.
SHARED_HEAD = 7
SEPARATOR = "\u0001"


def mask_generic(message: Column) -> Column:
    """Instants, addresses and identifiers, replaced inside the JVM.

    Digits and word characters are the Unicode classes. The address rule is one character
    class, which needs no backtracking on long texts.
    """
    rules = dict(mask_rules())
    result = message
    for name in GENERIC_MASKS:
        pattern = rules[name].replace(r"\d", r"\p{Nd}").replace(r"\w", r"[\p{L}\p{N}_]")
        if name == "URL":
            pattern = "https?://[a-zA-Z0-9$-_@.&+!*(),]+"
        result = F.regexp_replace(result, pattern, f"<:{name}:>")
    return result


def _literals(pattern: str) -> dict[str, int]:
    """Plain texts that every match contains, with how often."""
    found, plain, at = Counter(), "", 0

    def close():
        nonlocal plain
        if plain:
            found[plain] += 1
        plain = ""

    while at < len(pattern):
        if pattern[at] == "[":  # a class; the first character in it may be a bracket
            close()
            at = pattern.index("]", at + 2) + 1
        elif pattern[at] in "(|":  # alternatives and groups: what came before is enough
            return {} if "|" in re.sub(r"\[.*?\]|\(.*\)", "", pattern) else (close(), found)[1]
        elif pattern[at] in "?*{":
            plain = plain[:-1]
            close()
            at = pattern.index("}", at) + 1 if pattern[at] == "{" else at + 1
        elif pattern[at] in "+.^$":
            close()
            at += 1
        elif pattern[at] == "\\":
            if pattern[at + 1].isalnum():
                close()
            else:
                plain += pattern[at + 1]
            at += 2
        else:
            plain += pattern[at]
            at += 1
    close()
    return found


def _in_runs(rules: list[tuple[str, str]]) -> list[tuple[str, list]]:
    """The rules in order, as runs of neighbours whose first literals begin alike."""
    runs = []
    for name, pattern in rules:
        needed = _literals(pattern)
        head = next(iter(needed), "")
        rule = (head, list(needed.items())[1:] + [(head, n) for n in [needed[head]] if n > 1],
                re.compile(pattern), f"<:{name}:>")
        common = os.path.commonprefix([runs[-1][0], head]) if runs else ""
        if len(common) >= min(SHARED_HEAD, len(head)) and common:
            runs[-1] = (common, [*runs[-1][1], rule])
        else:
            runs.append((head, [rule]))
    return runs


def mask_all_udf(rules: list[tuple[str, str]] | None = None):
    """Arrow function that applies the whole ordered rule list.

    A rule runs only on texts that hold the literals it needs, and a run of rules only on texts
    that hold what these begin with; both look at the text as the earlier rules left it.
    """
    runs = _in_runs(mask_rules() if rules is None else rules)

    def one(text):
        if text is None:
            return None
        for head, members in runs:
            if head in text:
                for first, others, pattern, label in members:
                    if first in text and (not others or all(
                            text.count(x) >= n for x, n in others)):
                        text = pattern.sub(lambda _: label, text)
        return text

    @F.pandas_udf("string")
    def mask(messages: pd.Series) -> pd.Series:
        return messages.map(one)

    return mask


def masked_messages(messages: DataFrame, column: str = "message", full: bool = True) -> DataFrame:
    """Distinct messages with their masked form; the rules see every text only once."""
    texts = messages.where(F.col(column).isNotNull()).select(column).distinct()
    text = F.col(column)
    return texts.withColumn("masked", mask_all_udf()(text) if full else mask_generic(text))


def tokens_of(masked: Column) -> Column:
    blanks = " " * len(TOKEN_DELIMITERS)
    parts = F.split(F.translate(masked, TOKEN_DELIMITERS, blanks), SPACES)
    return F.filter(parts, lambda token: token != F.lit(""))


def leaf_of(tokens: Column, prefix: int = PREFIX_TOKENS) -> Column:
    """Key of the template a token list belongs to.

    If the prefix holds no plain token, the first plain token after it (or, without any,
    the whole text) takes part, so that members always share at least one token.
    """
    def no_digit(token):
        return ~F.rlike(token, F.lit(r"\p{Nd}"))

    count = F.size(tokens)
    length = F.greatest(F.least(count - F.lit(1), F.lit(prefix)), F.lit(0))
    head = F.slice(tokens, F.lit(1), length)
    path = F.transform(head, lambda t: F.when(no_digit(t), t).otherwise(F.lit(WILDCARD)))
    plain = F.filter(
        F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.alias("t"))),
        lambda s: no_digit(s["t"]),
    )
    first = F.get(plain, F.lit(0))
    anchor = F.when(F.exists(head, no_digit), F.lit("")).when(
        first.isNotNull(), F.concat_ws(SEPARATOR, first["i"].cast("string"), first["t"])
    ).otherwise(F.array_join(tokens, SEPARATOR))
    return F.concat_ws(SEPARATOR, count.cast("string"), F.array_join(path, SEPARATOR), anchor)


def tokenized(masked: DataFrame, column: str = "masked") -> DataFrame:
    tokens = masked.withColumn("tokens", tokens_of(F.rtrim(F.col(column))))
    return tokens.withColumn("template_id", F.md5(leaf_of(F.col("tokens"))))


def mine_templates(
    messages: DataFrame, column: str = "message", full: bool = True
) -> DataFrame:
    """Template table: id, token list, text and the number of messages behind it."""
    sizes = messages.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("_n")
    )
    text = F.col(column)
    masked = sizes.withColumn("masked", mask_all_udf()(text) if full else mask_generic(text))
    merged = masked.groupBy("masked").agg(F.sum("_n").alias("_n"))
    leaves = cut_lineage(tokenized(merged).select("template_id", "tokens", "_n"))
    heads = leaves.groupBy("template_id").agg(
        F.sum("_n").alias("size"), F.count(F.lit(1)).alias("_members"),
        F.any_value("tokens").alias("tokens"),
    )
    return heads.join(_wildcards(leaves, heads), "template_id", "left").select(
        "template_id", _with_wildcards().alias("template_tokens"), "size"
    ).withColumn("template", F.array_join("template_tokens", " "))


def _wildcards(leaves: DataFrame, heads: DataFrame) -> DataFrame:
    """Per template a flag for every position: do its messages differ there?

    Positions compare two hashes of their tokens, which keeps the exploded rows narrow and
    the aggregation in fixed-width buffers. Templates with one message have no wildcards.
    """
    several = heads.where(F.col("_members") > F.lit(1)).select("template_id")
    words = leaves.join(several, "template_id", "left_semi").select(
        "template_id", F.posexplode("tokens").alias("pos", "token")
    )
    hashed = words.select(
        "template_id", "pos", F.xxhash64("token").alias("a"),
        F.xxhash64(F.lit(1), "token").alias("b"),
    )
    spread = hashed.groupBy("template_id", "pos").agg(
        F.min("a").alias("a0"), F.max("a").alias("a1"),
        F.min("b").alias("b0"), F.max("b").alias("b1"),
    )
    differs = (F.col("a0") != F.col("a1")) | (F.col("b0") != F.col("b1"))
    flags = F.array_sort(F.collect_list(F.struct("pos", differs.alias("differs"))))
    return spread.groupBy("template_id").agg(flags.alias("_f")).select(
        "template_id", F.col("_f.differs").alias("_flags")
    )


def _with_wildcards() -> Column:
    replaced = F.zip_with(
        "tokens", "_flags", lambda token, differs: F.when(differs, F.lit(WILDCARD)).otherwise(token)
    )
    return F.when(F.col("_flags").isNull(), F.col("tokens")).otherwise(replaced)


def match_templates(
    messages: DataFrame, templates: DataFrame, column: str = "message", full: bool = True
) -> DataFrame:
    """Distinct messages with their template, NULL where none fits; templates never grow."""
    parsed = tokenized(masked_messages(messages, column, full))
    known = templates.select("template_id", "template", "template_tokens")
    pairs = F.arrays_zip(F.col("tokens"), F.col("template_tokens"))

    def agrees(pair):
        return (pair["template_tokens"] == F.lit(WILDCARD)) | (
            pair["template_tokens"] == pair["tokens"]
        )

    fits = F.coalesce(F.forall(pairs, agrees), F.lit(False))
    joined = parsed.join(known, "template_id", "left")
    values = F.transform(
        F.filter(pairs, lambda p: p["template_tokens"] == F.lit(WILDCARD)), lambda p: p["tokens"]
    )
    return joined.select(
        column, "masked",
        F.when(fits, F.col("template_id")).alias("template_id"),
        F.when(fits, F.col("template")).alias("template"),
        F.when(fits, values).alias("params"),
    )


def attach_templates(
    logs: DataFrame, matched: DataFrame, column: str = "message"
) -> DataFrame:
    """Every log row with the template of its message."""
    return logs.join(matched.select(column, "template_id", "template"), column, "left")


def template_catalogue(templates: DataFrame) -> DataFrame:
    return templates.select("template_id", "template", F.col("size").alias("count"))


def template_examples(
    messages: DataFrame,
    matched: DataFrame,
    order: list[str],
    column: str = "message",
    limit: int = MAX_EXAMPLES,
) -> DataFrame:
    """Up to ``limit`` distinct messages per template in order of first appearance."""
    seen = messages.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.min(F.struct(*order)).alias("_first")
    )
    known = matched.where(F.col("template_id").isNotNull()).select(column, "template_id")
    by_first = Window.partitionBy("template_id").orderBy("_first", column)
    ranked = seen.join(known, column).withColumn("example_no", F.row_number().over(by_first))
    return ranked.where(F.col("example_no") <= F.lit(limit)).select(
        "template_id", "example_no", column
    )


def top_n_with_ties(templates: DataFrame, n: int = TOP_TEMPLATES) -> DataFrame:
    """Templates at least as large as the ``n``-th largest one."""
    edge = templates.select("size").orderBy(F.col("size").desc()).limit(n)
    least = edge.agg(F.min("size")).scalar()
    return templates.where(F.col("size") >= least)
