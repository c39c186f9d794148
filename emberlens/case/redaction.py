"""Redaction of rows before they are shown: rules in their order, as Columns, with counts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for a masked value and after a cut, and the bound of a text.
MASK, CUT, MOST_CHARS = "[masked]", " …[cut]", 16_384
PATHS = ("path", "source_path", "file_path", "original_path", "origin_id")
KINDS = ("omit", "mask", "replace_exact", "replace_regex", "pseudonymize")


@dataclass(frozen=True)
class Profile:
    """``rules`` are ``(kind, *arguments)``; denied fields go, and if any are allowed, all others go."""

    rules: tuple[tuple, ...] = ()
    deny: tuple[str, ...] = ()
    allow: tuple[str, ...] = ()
    path_policy: str = "omit"  # or basename, include
    most_chars: int = MOST_CHARS

    def __post_init__(self):
        for kind, *arguments in self.rules:
            if kind not in KINDS:
                raise ValueError(f"unknown rule {kind!r}")
            if kind == "replace_exact" and not arguments[0]:
                raise ValueError("an exact replacement needs a text to find")
            if kind == "replace_regex":
                re.compile(arguments[0])
        if self.path_policy not in ("omit", "basename", "include"):
            raise ValueError(f"unknown path policy {self.path_policy!r}")


def text(column: Column, profile: Profile) -> tuple[Column, Column]:
    """A text after the replacements and the bound, and how many of each it took."""
    out, hits = column, F.lit(0)
    for kind, *arguments in profile.rules:
        if kind == "replace_exact":
            hits = hits + F.coalesce(F.regexp_count(out, F.lit(re.escape(arguments[0]))), F.lit(0))
            out = F.replace(out, F.lit(arguments[0]), F.lit(arguments[1]))
        elif kind == "replace_regex":
            hits = hits + F.coalesce(F.regexp_count(out, F.lit(arguments[0])), F.lit(0))
            out = F.regexp_replace(out, arguments[0], arguments[1])
    long = F.coalesce(F.length(out) > profile.most_chars, F.lit(False))
    return F.when(long, F.concat(F.substring(out, 1, profile.most_chars), F.lit(CUT))).otherwise(out), hits + long.cast("int")


def pseudonym(prefix: str, value: Column) -> Column:
    """Equal values have equal names, different ones different names, as far as 64 bits tell; no secret is involved."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(value.cast("string"), 256), 1, 16))


def redact(rows: DataFrame, profile: Profile) -> DataFrame:
    """``rows`` as the profile lets them be seen, with ``redactions``, how many changes a row took."""
    columns, hits = [], F.lit(0)
    for name in rows.columns:
        value = F.col(name)
        some = F.when(value.isNotNull(), 1).otherwise(0)
        own = [r for r in profile.rules if r[0] in ("omit", "mask", "pseudonymize") and r[1] == name]
        if name in profile.deny or (profile.allow and name not in profile.allow) or (own and own[0][0] == "omit"):
            hits = hits + some
            continue
        if own and own[0][0] == "mask":
            columns.append(F.when(value.isNotNull(), F.lit(MASK)).alias(name))
            hits = hits + some
        elif own:
            columns.append(F.when(value.isNotNull(), pseudonym(own[0][2], value)).alias(name))
            hits = hits + some
        elif name in PATHS and profile.path_policy != "include":
            shown = F.lit("[path omitted]") if profile.path_policy == "omit" else F.regexp_extract(value, r"([^/\\]*)$", 1)
            columns.append(F.when(value.isNotNull(), shown).alias(name))
            hits = hits + some
        elif dict(rows.dtypes)[name] == "string":
            out, n = text(value, profile)
            columns.append(out.alias(name))
            hits = hits + n
        else:
            columns.append(value)
    return rows.select(*columns, hits.cast("long").alias("redactions"))
