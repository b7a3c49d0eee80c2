"""Block extraction from document text and reference checks over catalogues."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runqc.functions.common import first_match

# Display environments.
EQUATION_ENVIRONMENTS = ["equation", "align", "align*", "gather", "multline"]

# Mark of a core equation, characters of context.
CORE_MARK = r"\\CEanchor\{\d+\}"
CONTEXT = 200

BLANKS = " \t\n\r\f\x0b"
STRIDE = 64

# Symbols counted as variables.
GREEK = (
    "alpha|beta|gamma|delta|epsilon|pi|sigma|lambda|mu|nu|rho|tau|omega|"
    "Gamma|Delta|Theta|Lambda|Sigma|Omega"
)
VARIABLE_TYPES = [
    (["probability", "likelihood", "posterior"], "probability"),
    (["count", "number", "size"], "count"),
    (["rate", "fraction", "ratio"], "rate"),
    (["score", "quality"], "score"),
]

# Units by the first pattern that occurs near a definition, and how far near is.
UNITS = [
    ("base pairs?|bp", "base pairs"),
    ("probability|dimensionless", "dimensionless"),
    ("percentage?|%", "percentage"),
    ("count|number", "count"),
    ("reads?", "reads"),
]
UNIT_CONTEXT = 500


def _escape(text: str) -> str:
    return text.replace("*", r"\*")


def blocks_between(docs: DataFrame, keys: Sequence[str], text: str, opening: str, closing: str, kind: str) -> DataFrame:
    """Every non-nested ``opening … closing`` block with its line number.

    The text is split at the opening marks, so the work is one pass over the whole document; the
    line number is 1 plus the newlines of everything before the block.
    """
    pieces = F.split(F.col(text), opening)
    # A piece after an opening mark is a block when the closing mark occurs in it.
    rows = docs.select(
        *keys,
        F.posexplode(F.transform(
            pieces,
            lambda p: F.struct(
                p.alias("piece"), (F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))).alias("newlines")
            ),
        )).alias("i", "p"),
        F.transform(pieces, lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))).alias("_nl"),
    )
    found = rows.where((F.col("i") > 0) & F.col("p.piece").rlike(closing))
    before = F.aggregate(F.slice("_nl", F.lit(1), F.col("i")), F.lit(0), lambda a, x: a + x)
    return found.select(
        *keys,
        F.lit(kind).alias("kind"),
        F.col("i").alias("ordinal"),
        (before + 1).alias("line_number"),
        F.trim(F.split("p.piece", closing, 2)[0]).alias("content"),
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, also where ``body`` uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _joined(pieces: Column, marks: Column, first: Column, n_pieces: Column, n_marks: Column) -> Column:
    """The text from piece ``first`` (from 0) on: pieces with the marks that follow them."""
    one = lambda p, m: F.array(p, F.coalesce(m, F.lit("")))
    return F.array_join(F.flatten(F.zip_with(F.slice(pieces, first + 1, n_pieces), F.slice(marks, first + 1, n_marks), one)), "")


def _strides(values: Column) -> Column:
    """Running sums of whole strides of an array: entry k is the sum of the first k strides."""
    add, none = lambda a, x: a + x, F.lit(0)
    at = F.sequence(F.lit(0), F.floor(F.size(values) / STRIDE).cast("int"))
    sums = F.transform(at, lambda k: F.aggregate(F.slice(values, k * STRIDE + 1, F.lit(STRIDE)), none, add))
    return F.aggregate(sums, F.array(none), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def _before(values: Column, strides: Column) -> Callable[[Column], Column]:
    """Sum of the first i values as a function of i, which reads one stride at most."""
    def total(i: Column) -> Column:
        k = F.floor(i / STRIDE).cast("int")
        return F.get(strides, k) + F.aggregate(F.slice(values, k * STRIDE + 1, i - k * STRIDE), F.lit(0), lambda a, x: a + x)

    return total


def environments(
    docs: DataFrame, keys: Sequence[str], text: str, kinds: Mapping[str, tuple[str, str]],
    core: str | None = None, context: int = CONTEXT,
) -> DataFrame:
    """All blocks of all ``kinds`` (kind -> opening and closing mark, as they stand) in one scan of each text.

    A block goes from an opening mark to the next closing mark of its kind; marks of the same kind in between are
    content, a closing mark without an opening one and an opening mark that is never closed make no block. Kinds do not
    hinder each other, so a block may lie in one of another kind. Columns: keys, kind, ordinal (within the kind, from
    1), line_number (of the opening mark), content without outer blanks, before and after (up to ``context`` characters
    around the block), is_core (``core``, a pattern, occurs in ``before``). Texts without blocks, empty and NULL texts
    give no rows.

    The text is cut at all marks once. Among the marks of one kind, a block begins at each opening mark that follows a
    closing one or nothing, and ends at each closing mark that follows an opening one; the two lists pair up in order.
    """
    marks = sorted({m for pair in kinds.values() for m in pair}, key=lambda m: (-len(m), m))
    if any("\n" in m or "\\E" in m or not m for m in marks):
        raise ValueError("marks are single-line, non-empty strings")
    pattern = "|".join(rf"\Q{m}\E" for m in marks)
    reach = context // len(marks[-1]) + 1
    newlines = lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))

    def of(kind: str, pieces: Column, found: Column, newlines_before: Callable[[Column], Column]) -> Column:
        opening, closing = kinds[kind]
        own = F.filter(F.transform(found, lambda m, i: F.struct(i.alias("at"), (m == opening).alias("opens"), m.alias("m"))), lambda x: x["m"].isin(opening, closing))

        def paired(own: Column) -> Column:
            after_open = lambda i: F.coalesce(F.get(own, i - 1)["opens"], F.lit(False))
            starts = F.filter(own, lambda x, i: x["opens"] & ~after_open(i))
            ends = F.filter(own, lambda x, i: ~x["opens"] & after_open(i))
            return F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s["at"].alias("s"), e["at"].alias("e"))), lambda b: b["e"].isNotNull())

        def block(b: Column, i: Column) -> Column:
            first = F.greatest(b["s"] - reach, F.lit(0))
            before = F.right(_joined(pieces, found, first, b["s"] - first + 1, b["s"] - first), F.lit(context))
            return F.struct(
                F.lit(kind).alias("kind"), (i + 1).alias("ordinal"), (newlines_before(b["s"] + 1) + 1).alias("line_number"),
                F.trim(_joined(pieces, found, b["s"] + 1, b["e"] - b["s"], b["e"] - b["s"] - 1), F.lit(BLANKS)).alias("content"),
                before.alias("before"),
                F.left(_joined(pieces, found, b["e"] + 1, F.lit(reach + 1), F.lit(reach + 1)), F.lit(context)).alias("after"),
            )

        return F.transform(_let(own, paired), block)

    def everything(pieces: Column) -> Column:
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        return _let(found, lambda found: _let(F.transform(pieces, newlines), lambda nl: _let(
            _strides(nl), lambda sums: F.concat(*[of(k, pieces, found, _before(nl, sums)) for k in kinds]))))

    rows = docs.select(*keys, F.explode(_let(F.split(F.col(text), pattern, -1), everything)).alias("b")).select(*keys, "b.*")
    return rows.withColumn("is_core", F.lit(False) if core is None else F.col("before").rlike(core))


def captions(blocks: DataFrame, caption: str, label: str, missing: str = "No caption") -> DataFrame:
    """``blocks`` with ``caption`` and ``label``: the first group of either pattern in the content, NULL label if none."""
    found = lambda p: F.nullif(F.regexp_extract("content", p, 1), F.lit(""))
    return blocks.withColumn("caption", F.coalesce(found(caption), F.lit(missing))).withColumn("label", found(label))


def _latex(*names: str) -> dict[str, tuple[str, str]]:
    return {n: (rf"\begin{{{n}}}", rf"\end{{{n}}}") for n in names}


def equations(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """LaTeX display environments with label, core flag, context and line number; ``environments`` says which."""
    out = environments(docs, keys, text, _latex(*EQUATION_ENVIRONMENTS), CORE_MARK)
    label = F.regexp_extract("content", r"\\label\{([^}]+)\}", 1)
    return out.withColumn("label", F.nullif(label, F.lit(""))).withColumn("symbols", symbols("content"))


def figures_and_tables(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Figure and table environments with their captions; a label is made from kind, keys and ordinal where none is."""
    out = captions(environments(docs, keys, text, _latex("figure", "table")), r"(?s)\\caption\{(.*?)\}", r"(?s)\\label\{(.*?)\}")
    return out.withColumn("label", F.coalesce("label", F.concat_ws("_", "kind", *keys, F.col("ordinal").cast("string"))))


def symbols(latex: Column | str) -> Column:
    """Sorted distinct variable symbols of a formula."""
    latex = F.col(latex) if isinstance(latex, str) else latex
    grab = lambda p, g: F.regexp_extract_all(latex, F.lit(p), F.lit(g))
    single = grab(r"(?<![a-zA-Z])([a-zA-Z])(?![a-zA-Z])", 1)
    greek = F.transform(grab(rf"\\({GREEK})", 1), lambda g: F.concat(F.lit("\\"), g))
    operators = grab(r"(\\Prob|\\mathbb\{[EP]\})", 1)
    subscripts = grab(r"([A-Za-z]_\{\\text\{[^}]+\}\})", 1)
    return F.array_sort(F.array_distinct(F.concat(single, greek, operators, subscripts)))


def variable_definitions(docs: DataFrame, keys: Sequence[str], text: str = "text", context: int = UNIT_CONTEXT) -> DataFrame:
    """``$symbol$ is/denotes/represents …`` definitions with a normalised id, inferred type and units.

    Units are those of the first pattern of ``UNITS`` that occurs in the definition or within ``context`` characters
    of it; NULL without one.
    """
    # Fixed value: what introduces a definition.
    pattern = r"(?i)(\$[^$]+\$\s+(?:represents?|denotes?|is|indicates?)\s+[^.]+)"
    reach = context // len("$x$ is y") + 1

    def near(pieces: Column, hits: Column, hit: Column, i: Column) -> Column:
        first = F.greatest(i - reach, F.lit(0))
        before = F.right(_joined(pieces, hits, first, i - first + 1, i - first), F.lit(context))
        after = F.left(_joined(pieces, hits, i + 1, F.lit(reach + 1), F.lit(reach + 1)), F.lit(context))
        return F.concat(before, hit, after)

    def found(pieces: Column) -> Column:
        every = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        return _let(every, lambda hits: F.transform(hits, lambda h, i: F.struct(h.alias("hit"), near(pieces, hits, h, i).alias("near"))))

    hits = docs.select(*keys, F.posexplode(_let(F.split(F.col(text), pattern, -1), found)).alias("ordinal", "h")).select(*keys, "ordinal", "h.*")
    symbol = F.trim(F.regexp_extract("hit", r"^\$([^$]+)\$", 1))
    description = F.trim(F.regexp_extract("hit", r"(?is)^\$[^$]+\$\s+(?:represents?|denotes?|is|indicates?)\s+(.*)$", 1))
    units = first_match([(F.col("near").rlike(f"(?i){p}"), unit) for p, unit in UNITS])
    parsed = hits.select(*keys, "ordinal", symbol.alias("symbol"), description.alias("description"), units.alias("units"))
    lowered = F.lower("description")
    kind = first_match([
        (F.greatest(*[F.contains(lowered, F.lit(w)) for w in words]), name) for words, name in VARIABLE_TYPES
    ])
    plain = F.regexp_replace(F.replace("symbol", F.lit("^"), F.lit("_")), "[^a-zA-Z0-9_]", "")
    return parsed.select(
        "*", F.concat(F.lit("var_"), plain).alias("var_id"), kind.alias("math_type")
    )


def dangling_references(items: DataFrame, id_col: str, refs_col: str) -> DataFrame:
    """(item, reference) pairs that name no existing item."""
    edges = items.select(F.col(id_col).alias("item"), F.explode(refs_col).alias("reference")).distinct()
    return edges.join(items.select(F.col(id_col).alias("reference")), "reference", "left_anti").select("item", "reference")


def usage_mismatch(claimed: DataFrame, actual: DataFrame) -> DataFrame:
    """Claimed against actual usage, both ways, as (variable, user, problem) rows.

    Both sides are (variable, user) edges, so a variable used everywhere is just many rows. Usage
    of variables that claim nothing at all is the orphan check's business, not this one's.
    """
    c = claimed.select("variable", "user").distinct().withColumn("c", F.lit(1))
    a = actual.select("variable", "user").distinct().withColumn("a", F.lit(1))
    both = c.join(a, ["variable", "user"], "full")
    kind = F.when(F.col("c").isNull(), "missing").when(F.col("a").isNull(), "extra")
    return both.select("variable", "user", kind.alias("problem")).where(F.col("problem").isNotNull())


def orphans(items: DataFrame, actual: DataFrame) -> DataFrame:
    """Variables no user refers to."""
    return items.select("variable").distinct().join(actual.select("variable"), "variable", "left_anti")


def undefined(items: DataFrame, actual: DataFrame) -> DataFrame:
    """Variables in use that are not defined."""
    return actual.select("variable").distinct().join(items.select("variable"), "variable", "left_anti")


def where_used(items: DataFrame, actual: DataFrame) -> DataFrame:
    """Every variable with its users, one row each; a variable nobody uses keeps one NULL row."""
    used = actual.select("variable", "user").distinct()
    return items.select("variable").distinct().join(used, "variable", "left")


def isolated(items: DataFrame, id_col: str, refs_col: str) -> DataFrame:
    """Items that refer to nothing and that nothing refers to."""
    incoming = items.select(F.explode(refs_col).alias(id_col)).distinct()
    quiet = items.where(F.coalesce(F.size(refs_col), F.lit(0)) <= 0)
    return quiet.select(id_col).join(incoming, id_col, "left_anti")


def category_share(items: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    counts = items.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias(column)).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.col("n") * 100.0 / whole)
