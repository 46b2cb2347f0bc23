"""Personal-data redaction of text columns with native expressions.

The seven stages run in a fixed order on the running text, each as its own
projection so a stage's input is computed once. Every stage first asks a cheap
question (a substring or one regex probe) and leaves other texts untouched.
Stages are SQL text over the name of their input: they nest inside lambdas, so
one definition serves columns, map values and array elements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.functions.text import NOT_AFTER_WORD, NOT_BEFORE_WORD

# What is looked for and what replaces it, in order.
LOCAL_CHARS = r"[a-zA-Z0-9._%+\-]"
DOMAIN = r"[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
SSN = rf"{NOT_AFTER_WORD}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{NOT_BEFORE_WORD}"
CARD_16 = rf"{NOT_AFTER_WORD}[0-9]{{4}}[- ]?[0-9]{{4}}[- ]?[0-9]{{4}}[- ]?[0-9]{{4}}{NOT_BEFORE_WORD}"
CARD_15 = rf"{NOT_AFTER_WORD}[0-9]{{4}}[- ]?[0-9]{{6}}[- ]?[0-9]{{5}}{NOT_BEFORE_WORD}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"{NOT_AFTER_WORD}(?:{_OCTET}\.){{3}}{_OCTET}{NOT_BEFORE_WORD}"
PRIVATE_IPV4 = r"\A(?:10\.|127\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)"
JWT = r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
BEARER = r"Bearer[\t\n\f\r ]+[A-Za-z0-9._~+/=\-]+"
EMAIL_MARK = "[REDACTED_EMAIL]"
SSN_MARK = "[REDACTED_SSN]"
CARD_MARK = "[REDACTED_CC]"
IP_MARK = "[REDACTED_IP]"
JWT_MARK = "[REDACTED_JWT]"
BEARER_MARK = "Bearer [REDACTED]"

# An address starts where the last one ended or where a run of its characters starts:
# what LOCAL_CHARS+@DOMAIN finds, but a long run without '@' is read once, not once per start.
EMAIL = rf"(?:\G|(?<!{LOCAL_CHARS})){LOCAL_CHARS}++@{DOMAIN}"

# Lengths of card numbers; in all bytes of a long: the low half, what makes 8 and more of 5 to 9, the lowest bit.
_LUHN_MIN, _LUHN_MAX = 13, 19
_LOW, _CARRY, _ONE = 0x0F0F0F0F0F0F0F0F, 0x0303030303030303, 0x0101010101010101

# A code point reserved for internal use; fences off matches while they are judged.
_FENCE = "\uFDD0"


def _luhn_sum_sql(digits: str) -> str:
    """The Luhn sum of at most 16 digits, the last of which counts once.

    Read as hexadecimal, every digit is half a byte: the high ones count doubled, less 9 from 5 on, for all bytes at once.
    The sum of the bytes is the remainder by 255, as it is less than that.
    """
    doubled = f"(shiftrightunsigned(x, 4) & {_LOW}L)"
    over = f"(shiftrightunsigned({doubled} + {_CARRY}L, 3) & {_ONE}L)"
    return f"transform(array(CAST(conv({digits}, 16, -10) AS BIGINT)), x -> ((x & {_LOW}L) + 2 * {doubled} - 9 * {over}) % 255)[0]"


def luhn_sql(text: str) -> str:
    """True when the 13 to 19 digits in ``text`` pass the Luhn check; the last 16 and those before them are summed apart."""
    total = f"{_luhn_sum_sql('right(d, 16)')} + if(length(d) > 16, {_luhn_sum_sql('left(d, length(d) - 16)')}, 0)"
    check = f"length(d) BETWEEN {_LUHN_MIN} AND {_LUHN_MAX} AND ({total}) % 10 = 0"
    return f"transform(array(regexp_replace({text}, '[^0-9]', '')), d -> {check})[0]"


def replace_unless_sql(text: str, pattern: str, mark: str, keep: Callable[[str], str]) -> str:
    """Replace matches of ``pattern``, except those ``keep`` accepts; kept matches are still consumed.

    Matches are fenced by one replacement, so every second piece between fences is
    a match. A text that holds the fence itself is split on the pattern instead.
    """
    pieces = f"split(regexp_replace({text}, r'{pattern}', '{_FENCE}$0{_FENCE}'), '{_FENCE}', -1)"
    fenced = f"array_join(transform({pieces}, (p, i) -> if(i % 2 = 0 OR {keep('p')}, p, '{mark}')), '')"
    found = f"transform(regexp_extract_all({text}, r'{pattern}', 0), m -> if({keep('m')}, m, '{mark}'))"
    zipped = f"array_join(zip_with(split({text}, r'{pattern}', -1), {found}, (g, m) -> concat(g, coalesce(m, ''))), '')"
    return (
        f"CASE WHEN NOT rlike({text}, r'{pattern}') THEN {text} WHEN contains({text}, '{_FENCE}') THEN {zipped}"
        f" WHEN {text} IS NOT NULL THEN {fenced} END"
    )


def _plain(text: str, hint: str, pattern: str, mark: str) -> str:
    return f"if(contains({text}, '{hint}'), regexp_replace({text}, r'{pattern}', '{mark}'), {text})"


def _not_card(match: str) -> str:
    return f"NOT {luhn_sql(match)}"


def _private(match: str) -> str:
    return f"rlike({match}, r'{PRIVATE_IPV4}')"


STAGES: tuple[tuple[str, Callable[[str], str]], ...] = (
    ("email", lambda t: _plain(t, "@", EMAIL, EMAIL_MARK)),
    ("ssn", lambda t: _plain(t, "-", SSN, SSN_MARK)),
    ("card_16", lambda t: replace_unless_sql(t, CARD_16, CARD_MARK, _not_card)),
    ("card_15", lambda t: replace_unless_sql(t, CARD_15, CARD_MARK, _not_card)),
    ("ipv4", lambda t: replace_unless_sql(t, IPV4, IP_MARK, _private)),
    ("jwt", lambda t: _plain(t, "eyJ", JWT, JWT_MARK)),
    ("bearer", lambda t: _plain(t, "Bearer", BEARER, BEARER_MARK)),
)


def luhn_valid(column: str) -> Column:
    return F.expr(luhn_sql(column))


def redact_sql(text: str) -> str:
    """All stages on one value, each computed once, for places a projection cannot reach."""
    for _, stage in STAGES:
        text = f"transform(array({text}), t -> {stage('t')})[0]"
    return text


def redact_values(column: str) -> Column:
    """A string map with every value redacted."""
    return F.expr(f"transform_values({column}, (k, v) -> {redact_sql('v')})")


def redact_columns(df: DataFrame, columns: str | list[str], hits: str | None = None) -> DataFrame:
    """Redact string columns in place; ``hits`` adds the number of stages that changed each row's text.

    With several columns ``hits`` counts (column, stage) pairs.
    """
    names = [columns] if isinstance(columns, str) else list(columns)
    last = len(STAGES)

    def at(stage: int, name: str) -> str:
        return f"`{name}`" if stage == 0 else f"__stage{stage}_{names.index(name)}"

    staged = df
    for i, (_, stage) in enumerate(STAGES):
        staged = staged.withColumns({at(i + 1, n): F.expr(stage(at(i, n))) for n in names})
    out = [f"{at(last, c)} AS `{c}`" if c in names else f"`{c}`" for c in df.columns]
    if hits is not None:
        changed = [f"int(coalesce({at(i, n)} <> {at(i + 1, n)}, false))" for n in names for i in range(last)]
        out.append(f"{' + '.join(changed)} AS `{hits}`")
    return staged.selectExpr(*out)
