"""Message templates: variable parts of a message become marks, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BYTES, MOST_TOKENS = 8192, 512
_IP4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
#: What a token's core must be, in the order of trial, its mark, and the switch that turns it off.
MASKS = (
    ("url", r"[A-Za-z0-9+.-]+://(?s:.*)", "<url>"),
    ("path", r"/[^/]*/(?s:.*)|[A-Za-z]:[\\/](?s:.+)|(?s:.*)\\(?s:.*)\\(?s:.*)", "<path>"),
    ("timestamp", r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?s:.*)|[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,](?s:.*))?", "<ts>"),
    ("uuid", r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", "<uuid>"),
    ("trace_span_hex", r"(?=.*[0-9])(?:[0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})", "<id>"),
    ("ip", rf"{_IP4}:[0-9]{{1,5}}", "<ip>:<port>"),
    ("ip", rf"{_IP4}|(?=.*[0-9A-Fa-f])[0-9A-Fa-f]*:[0-9A-Fa-f]*:[0-9A-Fa-f:]*", "<ip>"),
    ("hex0x", r"0[xX][0-9A-Fa-f]+", "<hex>"),
    ("duration", r"(?=.*[0-9])[0-9.]+(?:ns|us|µs|ms|s|m|h)", "<dur>"),
    ("byte_size", r"(?=.*[0-9])[0-9.]+(?:[KMGT]i?)?B", "<size>"),
    ("number", r"[-+]?[0-9]+(?:\.[0-9]+)?", "<num>"),
    ("bare_hex", r"(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{8,}", "<hex>"),
)
SWITCHES = ("quoted", *dict.fromkeys(name for name, _, _ in MASKS))
_LEAD, _TRAIL = r"^[(\[{'\"<]*", r"[)\]}.,;:!?'\">]*$"


def token_mask(token: Column, masks: tuple[str, ...] = SWITCHES) -> Column:
    """One token with its core masked; decoration around it stays."""
    if unknown := set(masks) - set(SWITCHES):
        raise ValueError(f"unknown masks: {sorted(unknown)}")
    quoted = token.rlike(r"""\A(?:"(?s:.*)"|'(?s:.*)')\z""") if "quoted" in masks else F.lit(False)
    # every mark needs one of these, which most tokens lack
    plain = ~token.rlike(r"""[0-9/\\:'"]""")
    return F.when(plain, token).when(quoted, F.lit("<q>")).otherwise(_let(_parts(token), lambda p: _marked(p, token, masks)))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(token: Column) -> Column:
    """A token's decoration before and after its core, and the core."""
    shape = rf"{_LEAD[:1]}({_LEAD[1:]})((?s:.*[^{_TRAIL[1:-2]})?)({_TRAIL[:-1]})$"  # one scan, however long a token's decoration
    return F.struct(*[F.regexp_extract(token, shape, i).alias(n) for i, n in ((1, "lead"), (2, "core"), (3, "trail"))])


def _marked(parts: Column, token: Column, masks: tuple[str, ...]) -> Column:
    mark = F.lit(None).cast("string")
    for name, pattern, text in reversed(MASKS):
        if name in masks:
            mark = F.when(parts["core"].rlike(rf"\A(?:{pattern})\z"), F.lit(text)).otherwise(mark)
    return F.coalesce(F.concat(parts["lead"], mark, parts["trail"]), token)


def template(message: Column, masks: tuple[str, ...] = SWITCHES, bounded: bool = True) -> Column:
    """Tokens masked and joined by single spaces; past the bounds of bytes or tokens the template ends in ``<truncated>``.
    Without bounds it is of the whole message."""
    if not bounded:
        words = F.filter(F.split(message, r"(?U)\s+"), lambda w: w != "")
        return F.array_join(F.transform(words, lambda w: token_mask(w, masks)), " ")
    long = F.octet_length(message) > MOST_BYTES
    body = F.when(long, _cut(message)).otherwise(message)
    words = F.filter(F.split(body, r"(?U)\s+"), lambda w: w != "")
    cut = long | (F.size(words) > MOST_TOKENS)
    masked = F.transform(F.slice(words, 1, MOST_TOKENS), lambda w: token_mask(w, masks))
    return F.array_join(F.when(cut, F.concat(masked, F.array(F.lit("<truncated>")))).otherwise(masked), " ")


def _cut(message: Column) -> Column:
    """The first bytes up to the bound, without the pieces of a character that it cuts."""
    part = F.substring(message.cast("binary"), 1, MOST_BYTES)
    return F.regexp_replace(F.make_valid_utf8(part.cast("string")), "�+$", "")


def pattern_id(template_text: Column, masks: tuple[str, ...] = SWITCHES) -> Column:
    return F.concat(F.lit("pat-"), F.substring(F.sha2(F.concat(F.lit(",".join(masks) + "\x1f"), template_text), 256), 1, 32))
