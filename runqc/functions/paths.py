"""Run metadata hidden in paths and names, from ordered pattern tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runqc.functions.common import col_of, first_match

# Patterns tried in order, the first that matches wins.
FLOWCELL = [r"([PF][A-Z]{2}\d{5})", r"([A-Z]{3}\d{5})"]
SAMPLE = [r"(?i)(HG\d{3,5})", r"(?i)(NA\d{5})", r"(?i)(GM\d{5})", r"(?i)(COLO829)", r"(?i)(K562)"]
RUN_ID = r"_([a-f0-9]{8})(?:[_/.]|$)"
BARCODE = r"(?i)(barcode\d{2})"
MODELS = ["sup", "hac", "fast"]
CHEMISTRY = [
    (r"r10\.?4\.?1", "R10.4.1"),
    (r"r10\.?4", "R10.4"),
    (r"r9\.?4\.?1", "R9.4.1"),
    (r"r9\.?4", "R9.4"),
    (r"e8\.?2", "E8.2"),
]
GENOME = [("grch38|hg38", "GRCh38"), ("grch37|hg19", "GRCh37"), ("chm13|t2t", "CHM13-T2T")]
MODIFICATIONS = [
    ("5mcg", "5mCG"), ("5hmcg", "5hmCG"), ("6ma", "6mA"), ("4mc", "4mC"), ("modbase", "modified_bases"),
]
KITS = ["SQK-LSK114", "SQK-LSK110", "SQK-LSK109", "SQK-NBD114", "SQK-RBK114", "SQK-16S114"]
DEVICE_BY_PREFIX = [("PA", "PromethION"), ("FA", "Flongle"), ("FB", "Flongle"), ("MN", "MinION")]
DATASET_DATE = r"(\d{4})[._]?(\d{2})(?:[._](\d{2}))?"
ADAPTIVE_WORDS = ["adaptive", "readfish", "enrich"]


def _grab(path: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))


def metadata(path: Column | str) -> dict[str, Column]:
    """All metadata fields of a path; a field that the path does not show is NULL."""
    p = col_of(path)
    low = F.lower(p)
    flowcell = F.coalesce(*[_grab(p, x) for x in FLOWCELL])
    model = first_match(
        [(low.contains(f"/{m}/") | low.contains(f".{m}") | low.contains(f"_{m}"), m) for m in MODELS]
    )
    mods = F.filter(
        F.array(*[F.when(low.contains(x), F.lit(name)) for x, name in MODIFICATIONS]), lambda m: m.isNotNull()
    )
    year, month = _grab(p, DATASET_DATE).cast("int"), F.nullif(F.regexp_extract(p, DATASET_DATE, 2), F.lit(""))
    in_range = year.between(2020, 2030) & month.cast("int").between(1, 12)
    hit = F.lit(False)
    for word in ADAPTIVE_WORDS:
        hit = hit | low.contains(word)
    return {
        "flowcell_id": flowcell,
        "sample": F.upper(F.coalesce(*[_grab(p, x) for x in SAMPLE])),
        "run_id": _grab(p, RUN_ID),
        "barcode": F.lower(_grab(p, BARCODE)),
        "basecall_model": model,
        "chemistry": first_match([(low.rlike(x), name) for x, name in CHEMISTRY]),
        "reference": first_match([(low.rlike(x), name) for x, name in GENOME]),
        "modifications": F.when(F.size(mods) > 0, mods),
        "replicate": _grab(p, r"(?i)rep(\d+)").cast("int"),
        "kit": first_match([(low.contains(k.lower()), k) for k in KITS]),
        "device_type": first_match([(flowcell.startswith(x), name) for x, name in DEVICE_BY_PREFIX]),
        "dataset_date": F.when(in_range, F.concat_ws("-", year.cast("string"), month)),
        "adaptive_sampling": hit,
        "duplex": low.contains("duplex"),
    }


def compact_date(text: Column | str) -> Column:
    """MMDDYYYY first, then YYYYMMDD, kept when the year lies in 2015-2030."""
    digits = col_of(text)
    year_ok = lambda d: F.when(F.year(d).between(2015, 2030), d)
    parse = lambda form: F.to_date(F.try_to_timestamp(digits, F.lit(form)))
    return F.coalesce(year_ok(parse("MMddyyyy")), year_ok(parse("yyyyMMdd")))


def iso_date(ts: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col_of(ts), r"^([^T.]+)T", 1), F.lit(""))


def iso_time(ts: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col_of(ts), r"T(.{5})", 1), F.lit(""))


def local_timestamp(ts: Column | str) -> Column:
    """ISO timestamp without fraction and zone offset."""
    plain = F.regexp_extract(col_of(ts), r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})", 1)
    return F.try_to_timestamp(F.nullif(plain, F.lit("")), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def duration_hours(start: Column | str, end: Column | str) -> Column:
    seconds = F.unix_timestamp(local_timestamp(end)) - F.unix_timestamp(local_timestamp(start))
    return seconds / F.lit(3600.0)
