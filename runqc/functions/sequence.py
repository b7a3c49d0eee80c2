"""Nucleotide strings, identifiers and model names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runqc.functions.common import col_of, first_match

# Modification bits.
MOD_BITS = {"non": 0, "6mA": 1, "5mCG_5hmCG": 2, "5mC_5hmC": 4, "4mC_5mC": 8, "5mC": 16}

# Model tier by name fragment, in order of precedence.
MODEL_TIERS = [("_sup@v", "s"), ("_hac@v", "h"), ("_fast@v", "f")]


def reverse_complement(seq: Column | str) -> Column:
    return F.translate(F.reverse(col_of(seq)), "ACGTacgt", "TGCAtgca")


def core(seq: Column | str) -> Column:
    """Only the upper-case part of a sequence."""
    return F.regexp_replace(col_of(seq), "[^A-Z]", "")


def assemble(*parts: Column | str) -> Column:
    return F.concat(*[col_of(p) for p in parts])


def chimera_length(*parts: Column | str) -> Column:
    """Two copies of the product joined end to end."""
    return sum((F.length(col_of(p)) for p in parts), F.lit(0)) * 2


def unique_read_id(exp: Column, tier: Column, version: Column, trim: Column, mods: Column, read_id: Column) -> Column:
    clean = F.coalesce(F.nullif(F.replace(version, F.lit("."), F.lit("")), F.lit("")), F.lit("0"))
    return F.concat(
        exp.cast("string"),
        F.coalesce(F.nullif(tier, F.lit("")), F.lit("x")),
        clean,
        F.lit("t"), trim.cast("string"),
        F.lit("m"), mods.cast("string"),
        F.lit("_"), F.substring(F.sha2(read_id, 256), 1, 8),
    )


def model_tier(rg: Column | str) -> Column:
    rg = col_of(rg)
    return first_match([(rg.rlike(rf"{frag}[\d.]+"), tier) for frag, tier in MODEL_TIERS])


def model_version(rg: Column | str) -> Column:
    rg = col_of(rg)
    return first_match(
        [(rg.rlike(rf"{frag}[\d.]+"), F.regexp_extract(rg, rf"{frag}([\d.]+)", 1)) for frag, _ in MODEL_TIERS]
    )


def mod_bitflag(mods: Column | str) -> Column:
    """OR of the bits of a ``+``-separated list; unknown names add nothing."""
    bits = F.create_map(*[F.lit(x) for pair in MOD_BITS.items() for x in pair])
    return F.aggregate(
        F.split(F.coalesce(col_of(mods), F.lit("")), r"\+"),
        F.lit(0),
        lambda acc, m: acc.bitwiseOR(F.coalesce(F.try_element_at(bits, F.trim(m)), F.lit(0))),
    )


def mod_table() -> list[tuple[int, str]]:
    """All legal combinations: each single modification, and 6mA with any one C modification."""
    singles = [(bit, name) for name, bit in MOD_BITS.items()]
    return singles + [(1 | bit, f"6mA+{name}") for name, bit in MOD_BITS.items() if bit > 1]


def filename_fields(name: Column | str) -> list[Column]:
    """exp, tier, version, trim and modifications from ``{exp}_{tier}_v{ver}_{trim}_{mods}.bam``.

    Other names yield the part before the first underscore when there are three parts or more.
    """
    stem = F.regexp_replace(col_of(name), r"\.[^.]*$", "")
    pattern = r"^(.+?)_([shf])_v([\d.]+)_(\d)_(.+)$"
    hit = stem.rlike(pattern)
    group = lambda i: F.when(hit, F.regexp_extract(stem, pattern, i))
    parts = F.split(stem, "_")
    return [
        F.coalesce(group(1), F.when(F.size(parts) >= 3, parts[0])).alias("exp_id"),
        group(2).alias("model_tier"),
        group(3).alias("model_ver"),
        group(4).cast("int").alias("trim"),
        F.when(hit, mod_bitflag(group(5))).otherwise(F.lit(0)).alias("mod_bitflag"),
    ]


def size_class(length: Column | str, low: Column | str, high: Column | str) -> Column:
    n = col_of(length)
    return first_match([(n < col_of(low), "short"), (n > col_of(high), "long")], "in_range")


def estimated_length(samples: Column | str, rate: Column | str, bases_per_second: int = 450) -> Column:
    """Bases expected from a signal of ``samples`` points at ``rate`` Hz."""
    seconds = F.try_divide(col_of(samples).cast("double"), col_of(rate))
    return (seconds * F.lit(float(bases_per_second))).cast("long")
