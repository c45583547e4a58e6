"""Column functions: codes, names, hashes, roundings, dates and messages."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXCHANGES = {"SSE": "SH", "SZSE": "SZ", "BSE": "BJ"}


def market_code(code: Column, shanghai: str = "69", digits_only: bool = False, required: bool = False) -> Column:
    """A vendor's code with its market: six characters get .SH, .BJ (4, 8) or .SZ by the first; codes with a dot and others stay; empty ones are null, or
    an error where a code is required."""
    c = F.nullif(F.upper(F.trim(code)), F.lit(""))
    six = c.rlike("^[0-9]{6}$") if digits_only else F.length(c) == 6
    first = F.substring(c, 1, 1)
    market = F.when(first.isin(*shanghai), ".SH").when(first.isin("4", "8"), ".BJ").otherwise(".SZ")
    coded = F.when(c.contains("."), c).when(six, F.concat(c, market)).otherwise(c)
    return F.coalesce(coded, F.raise_error(F.lit("a row has no code")).cast("string")) if required else coded


def split_code(code: Column) -> tuple[Column, Column]:
    """What stands before and after the first dot."""
    return F.substring_index(code, ".", 1), F.when(code.contains("."), F.substring(code, F.instr(code, ".") + 1, F.length(code)))


#: White space of any script, and the four separators U+001C to U+001F.
SPACES = r"(?U)[\s\x1c-\x1f]+"


def plain_name(name: Column) -> Column:
    """A name without any white space; null is empty."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), SPACES, "")


def exchange_code(exchange: Column) -> Column:
    """An exchange's short name in capitals; null is empty."""
    plain = F.upper(F.regexp_replace(F.coalesce(exchange, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    known = plain
    for long, short in EXCHANGES.items():
        known = F.when(plain == long, short).otherwise(known)
    return known


#: Characters that are their own normal form wherever they stand: no compatibility form, nothing to compose with, no mark (ASCII, most of Latin, Greek and Cyrillic letters,
#: dashes and quotation marks, kana, ideographs).
_SETTLED = r"^[\x00-\x7F\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0391-\u03A1\u03A3-\u03CE\u0400-\u0482\u2010\u2012-\u2016\u2018-\u2023\u3001-\u3029\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF]*$"


@F.arrow_udf(T.StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in (x.as_py() for x in values)], pa.string())


def plain_reason(reason: Column) -> Column:
    """NFKC form with white space collapsed; empty is null. Spark has no normal forms, hence an Arrow function; text that is its own form goes to it as null."""
    settled = (F.length(reason) == F.octet_length(reason)) | reason.rlike(_SETTLED)
    collapsed = F.trim(F.regexp_replace(F.coalesce(_nfkc(F.when(~settled, reason)), reason), r"\s+", " "))
    return F.nullif(collapsed, F.lit(""))


def reason_hash(reason: Column) -> Column:
    return F.sha2(plain_reason(reason), 256)


def content_hash(columns: Sequence[Column]) -> Column:
    """SHA-256 of the columns as text, joined by bars; nulls are empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def half_up(x: Column, places: int = 4) -> Column:
    return F.round(x, places)


def half_even(x: Column, places: int = 4) -> Column:
    return F.bround(x, places)


def windows_of(start: Column, end: Column, days: int) -> Column:
    """Stretches of so many days from start to end, the last one cut: an array of (window_start, window_end)."""
    begins = F.sequence(start, end, F.expr(f"interval {days} days"))
    return F.transform(begins, lambda d: F.struct(d.alias("window_start"), F.least(F.date_add(d, days - 1), end).alias("window_end")))


def months_of(start: Column, end: Column) -> Column:
    """The months from start to end as YYYYMM."""
    return F.transform(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyyMM"))


def month_start(text: Column) -> Column:
    """The first day of YYYYMM or YYYY-MM."""
    digits = F.regexp_replace(text, "-", "")
    return F.when(digits.rlike("^[0-9]{6}$"), F.to_date(F.concat(digits, F.lit("01")), "yyyyMMdd"))


def local_day_range(day: Column, zone: str = "Asia/Shanghai") -> tuple[Column, Column]:
    """The UTC instants at which a local day begins and the next one does."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone), F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def tagged_part(message: Column, tag: str = "data_quality_warning:") -> Column:
    """The first part of a message, between semicolons, that begins with a tag."""
    return F.get(F.filter(F.transform(F.split(message, ";"), lambda p: F.trim(p)), lambda p: p.startswith(tag)), F.lit(0))


#: How failure messages of a database and a vendor are told: pattern (any case) and summary with its groups. Fixed values.
FAILURES = (
    (r'column "([^"]+)" of relation "([^"]+)" does not exist', "数据库字段缺失：表 $2 缺少列 $1"),
    (r'null value in column "([^"]+)" of relation "([^"]+)" violates not-null constraint', "数据库约束错误：表 $2 的列 $1 不能为空"),
    (r"there is no unique or exclusion constraint matching the ON CONFLICT specification", "数据库约束错误：缺少可用于 ON CONFLICT 的唯一约束"),
)
#: Fixed value: a vendor's prefix and its summary.
VENDOR_ERROR = ("Tushare API error: ", "Tushare 接口错误：")


def failure_summary(message: Column, most: int = 120) -> Column:
    """A failure message in short: known database errors by their column and table, a vendor's by its prefix, others with white space collapsed and
    cut to most characters; empty is null."""
    plain = F.trim(F.regexp_replace(message, SPACES, " "))
    out = F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most), F.lit("..."))).otherwise(plain)
    out = F.when(plain.startswith(VENDOR_ERROR[0]), F.concat(F.lit(VENDOR_ERROR[1]), F.substring(plain, len(VENDOR_ERROR[0]) + 1, 1 << 20))).otherwise(out)
    for pattern, summary in reversed(FAILURES):
        told = F.lit(summary)
        for group in (1, 2) if "$" in summary else ():
            told = F.replace(told, F.lit(f"${group}"), F.regexp_extract(plain, f"(?i){pattern}", group))
        out = F.when(plain.rlike(f"(?i){pattern}"), told).otherwise(out)
    return F.when(message != "", out)


#: What a cut text ends in. A fixed value.
CUT_SUFFIX = "... [已截断]"


def clipped(text: Column, n: int = 120, suffix: str = CUT_SUFFIX) -> Column:
    """A text of at most n characters; a longer one keeps what leaves room for the suffix, and without any room is the suffix alone. No room at all is empty."""
    if n <= 0:
        return F.when(text.isNotNull(), "")
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, max(n - len(suffix), 0)), F.lit(suffix))).otherwise(text)


def freshness(text: Column) -> Column:
    """A date of ten characters or an ISO timestamp (with Z) as a timestamp, anything else null."""
    return F.when(F.length(text) == 10, F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).otherwise(F.try_to_timestamp(F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T"), text)))


def in_time_window(ts: Column, start: str, end: str) -> Column:
    """Whether the time of day lies in a window, which may pass midnight."""
    t = F.date_format(ts, "HH:mm:ss")
    return (t >= start) & (t <= end) if start <= end else (t >= start) | (t <= end)


def null_aware_sum(columns: Sequence[Column]) -> Column:
    """The sum of the values that are there; null if none is."""
    total = columns[0]
    some = F.coalesce(*columns).isNotNull()
    total = sum((F.coalesce(c, F.lit(0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0)))
    return F.when(some, total)
