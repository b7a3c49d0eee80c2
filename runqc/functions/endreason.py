"""End-reason normalisation and verdict rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runqc.functions.common import col_of, first_match, fixed1, messages

# Canonical end reasons, their integer codes and accepted spellings.
END_REASON_BY_CODE = {
    "0": "unknown",
    "1": "signal_positive",
    "2": "signal_negative",
    "3": "mux_change",
    "4": "unblock_mux_change",
    "5": "data_service_unblock_mux_change",
}
END_REASON_BY_NAME = {
    "signal_positive": "signal_positive",
    "signal_negative": "signal_negative",
    "mux_change": "mux_change",
    "unblock_mux_change": "unblock_mux_change",
    "data_service_unblock_mux_change": "data_service_unblock_mux_change",
    "unknown": "unknown",
    "data_service": "data_service_unblock_mux_change",
    "adaptive_sampling": "unblock_mux_change",
}
END_REASONS = list(END_REASON_BY_CODE.values())

# Substring categories in order of precedence.
CATEGORY_ORDER = [
    ("signal_positive", "signal_positive"),
    ("unblock", "unblock"),
    ("mux_change", "mux_change"),
    ("signal_negative", "signal_negative"),
]

# Spellings of a passed read.
PASS_WORDS = ["TRUE", "1", "PASS", "YES"]


def passes(flag: Column | str) -> Column:
    return F.coalesce(F.upper(F.trim(col_of(flag).cast("string"))).isin(PASS_WORDS), F.lit(False))


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def canonical(reason: Column | str, integer_codes: bool = True) -> Column:
    """Exact alias lookup; anything else is ``unknown``."""
    table = dict(END_REASON_BY_NAME)
    if integer_codes:
        table.update(END_REASON_BY_CODE)
    key = F.replace(F.lower(col_of(reason).cast("string")), F.lit(" "), F.lit("_"))
    return F.coalesce(F.try_element_at(_lookup(table), key), F.lit("unknown"))


def category(reason: Column | str) -> Column:
    """Substring category; the first listed fragment found wins."""
    r = F.coalesce(F.lower(F.trim(col_of(reason))), F.lit(""))
    return first_match([(r.contains(part), name) for part, name in CATEGORY_ORDER], "other")


def coarse_category(reason: Column | str) -> Column:
    """Three-way split used for channel maps: signal_positive, unblock, other."""
    table = {
        "signal_positive": "signal_positive",
        "unblock_mux_change": "unblock",
        "data_service_unblock_mux_change": "unblock",
    }
    return F.coalesce(F.try_element_at(_lookup(table), canonical(reason)), F.lit("other"))


def verdict(sp_pct: Column | str, sn_pct: Column | str) -> Column:
    """OK / CHECK / FAIL from percentages already rounded to two places."""
    sp, sn = col_of(sp_pct), col_of(sn_pct)
    return first_match([(sp < 50, "FAIL"), ((sp < 75) | (sn > 20), "CHECK")], "OK")


def verdict_issues(sp_pct: Column | str, sn_pct: Column | str) -> Column:
    sp, sn = col_of(sp_pct), col_of(sn_pct)
    return messages(
        F.when(sp < 50, F.concat(F.lit("signal_positive too low ("), fixed1(sp), F.lit("% < 50%)")))
        .when(sp < 75, F.concat(F.lit("signal_positive below optimal ("), fixed1(sp), F.lit("% < 75%)"))),
        F.when(sn > 20, F.concat(F.lit("high signal_negative ("), fixed1(sn), F.lit("% > 20%)"))),
    )


def adaptive_note(unblock_pct: Column | str, data_service_pct: Column | str) -> Column:
    total = col_of(unblock_pct) + col_of(data_service_pct)
    return F.when(
        total > 5,
        F.concat(F.lit("Adaptive sampling detected ("), fixed1(total), F.lit("% rejections)")),
    )
