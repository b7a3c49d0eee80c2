import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from runqc.operators import calibration as C
from runqc.operators import distributions as D
from runqc.operators import documents as X
from runqc.operators import grades as G
from runqc.operators import registry as R
from runqc.operators import tasks as T

TEX = r"""intro
\begin{equation}
a = \alpha b_{\text{max}} \label{eq:one}
\end{equation}
text $q$ denotes the quality score of a read. More.
\begin{align*}
\Prob x
\end{align*}
\begin{figure}
\caption{A
plot} \label{fig:p}
\end{figure}
\begin{table} none \end{table}
"""


def test_latex_blocks(rows):
    docs = rows([("d", TEX)], "doc string, text string")
    eq = {r.kind: r for r in X.equations(docs, ["doc"]).collect()}
    assert (eq["equation"].line_number, eq["equation"].label, eq["align*"].line_number, eq["align*"].label) == (2, "eq:one", 6, None)
    assert {"a", "\\alpha", "b_{\\text{max}}"} <= set(eq["equation"].symbols)
    assert {"\\Prob", "x"} <= set(eq["align*"].symbols)
    fig = {r.kind: r for r in X.figures_and_tables(docs, ["doc"]).collect()}
    assert (fig["figure"].caption, fig["figure"].label, fig["figure"].line_number) == ("A\nplot", "fig:p", 9)
    assert fig["table"].caption == "No caption" and fig["table"].label.startswith("table_d_")
    d = X.variable_definitions(docs, ["doc"]).first()
    assert (d.symbol, d.var_id, d.description, d.math_type) == ("q", "var_q", "the quality score of a read", "score")


def test_same_mark_twice_on_one_line(rows):
    docs = rows([("d", "x <p>one</p> y <p>two</p>\n<p>open")], "doc string, text string")
    got = X.blocks_between(docs, ["doc"], "text", "<p>", "</p>", "p").orderBy("ordinal").collect()
    assert [(r.content, r.line_number) for r in got] == [("one", 1), ("two", 1)]


def test_task_graph(rows):
    tasks = rows([("e", "a", 1, "passing", 2, []), ("e", "b", 2, "pending", 3, ["a"]), ("e", "c", 3, "failing", 1, ["b"]),
                  ("e", "d", 4, "pending", 1, ["c", "zz"]), ("e", "f", 5, "pending", 3, [])],
                 "experiment_id string, name string, ord int, status string, priority int, dependencies array<string>")
    assert {r.name for r in T.runnable(tasks).collect()} == {"b", "f"}
    assert {r.name for r in T.blocked(tasks).collect()} == {"d"}
    assert [tuple(r) for r in T.missing_dependencies(tasks).select("name", "dependency").collect()] == [("d", "zz")]
    assert T.next_task(tasks).first().name == "b"


def test_find_by_id(rows):
    df = rows([("exp-1", 1), ("exp-12", 2), ("run-9", 3)], "id string, v int")
    found = lambda t: [r.v for r in R.find_by_id(df, t).collect()]
    assert (found("exp-1"), found("run"), found("exp"), found("none")) == ([1], [3], [], [])


def test_deep_merge_keeps_what_the_update_lacks(rows):
    schema = "id int, d struct<a:int,b:struct<c:string>>, m map<string,string>"
    base = rows([(1, (1, ("x",)), {"k": "v", "o": "old"}), (2, None, None)], schema)
    update = rows([(1, (None, ("y",)), {"o": "new"}), (3, (5, None), {"z": "1"})], schema)
    got = {r.id: r for r in R.deep_merge(base, update, "id").collect()}
    assert (got[1].d.a, got[1].d.b.c, got[1].m) == (1, "y", {"k": "v", "o": "new"})
    assert got[2].d is None and got[3].d.a == 5 and got[3].m == {"z": "1"}


def test_schema_rules(rows):
    df = rows([(1, "5", ["1", "x"], "ok"), (2, None, None, "zz")], "id int, n string, xs array<string>, w string")
    schema = {"n": {"type": "int", "required": True, "min": 6}, "xs": {"items": "int", "min_length": 3},
              "w": {"validator": lambda c: c != "zz"}, "gone": {"required": True, "default": "d"}}
    got = {r.id: r for r in R.schema_validate(df, ["id"], schema).collect()}
    assert got[1].errors == ["Field 'n' value below min 6", "Field 'xs' length below min 3", "Field 'xs' has an item of wrong type",
                             "Required field 'gone' is missing"]
    assert got[2].errors == ["Required field 'n' is missing", "Field 'w' failed validation", "Required field 'gone' is missing"]
    assert R.apply_defaults(df, schema).first().gone == "d"


def test_a_structured_document_ends_the_legacy_warning_unless_it_is_empty(rows):
    names = "id string, name string, source string, sample string, device_type string, https_url string, browser_url string, schema_version string"
    fixed = ("exp-0123abcd", "n", "local", "s", "d", None, None, "1")
    full = '{"x": 1}'
    data = [fixed + (10.0, None, None, *x) for x in ((None, None, None), (full, None, None), (None, full, None), (None, None, full), ("{}", " { }", "null"))]
    df = rows(data, names + ", mean_quality double, total_reads bigint, n50 bigint, quality_metrics string, read_counts string, length_metrics string")
    legacy = ["metrics: legacy numbers only"]
    assert [r.warnings for r in R.validate(df, ["id"]).collect()] == [legacy, [], [], [], legacy]
    assert [r.warnings for r in R.validate(df.drop("read_counts", "length_metrics"), ["id"]).collect()] == [legacy, [], legacy, legacy, legacy]
    assert [r.warnings for r in R.validate(df.drop("quality_metrics", "read_counts", "length_metrics"), ["id"]).collect()] == [legacy] * 5
    typed = df.select("*", F.struct(F.lit(1).alias("x")).alias("q"), F.array().cast("array<int>").alias("r")).drop("quality_metrics", "read_counts")
    assert R.validate(typed.withColumnRenamed("q", "quality_metrics"), ["id"]).where("size(warnings) > 0").count() == 0
    assert R.validate(typed.withColumnRenamed("r", "read_counts"), ["id"]).where("size(warnings) > 0").count() == 4


def test_findings_of_a_poor_row(rows):
    got = R.validate(rows([(1, "x9", None, "elsewhere"), (2, "", "n", "unknown")], "k int, id string, name string, source string"), ["k"]).collect()
    assert (got[0].errors, got[0].warnings) == (["name: absent"], ["id: other form: x9", "source: not a listed one: elsewhere", "sample, device_type: both absent", "schema_version: absent"])
    assert (got[1].errors, got[1].is_valid) == (["id: absent", "source: absent or unknown"], False)


def test_library_grade_never_invents(rows):
    df = rows([(96.0, None, 0.1, 1.0), (96.0, 0.5, 0.1, 1.0)],
              "signal_positive_pct double, short_read_pct double, adapter_dimer_pct double, concatemer_pct double")
    assert [r[0] for r in df.select(G.library_grade()).collect()] == [None, "A"]


def test_isotonic_matches_pooling(rows):
    random.seed(4)
    data = [(p / 20, int(random.random() < (p / 20) ** 2)) for p in range(1, 20) for _ in range(30)]
    got = {r.p: r.p_cal for r in C.isotonic_recalibrate(rows(data, "p double, err int")).select("p", "p_cal").distinct().collect()}
    blocks = []
    for p in sorted(got):
        errs = [e for q, e in data if q == p]
        blocks.append([sum(errs), len(errs), [p]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, ps = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + ps]
    for s, n, ps in blocks:
        for p in ps:
            assert got[p] == pytest.approx(s / n, abs=1e-9)


def test_platt_recovers_a_logistic_curve(rows):
    data = []
    for i in range(1, 10):
        p = i / 10
        rate = 1 / (1 + math.exp(-(4 * p - 2)))
        data += [(p, 1)] * round(1000 * rate) + [(p, 0)] * round(1000 * (1 - rate))
    for r in C.platt_recalibrate(rows(data, "p double, err int")).select("p", "p_cal").distinct().collect():
        assert r.p_cal == pytest.approx(1 / (1 + math.exp(-(4 * r.p - 2))), abs=0.01)


def test_peaks_of_a_known_curve(rows):
    x = np.arange(600)
    y = np.exp(-((x - 150) / 20.0) ** 2) + 0.5 * np.exp(-((x - 400) / 30.0) ** 2) + 0.002 * np.sin(x)
    curve = rows([("a", int(i), float(i), float(v)) for i, v in zip(x, y)], "k string, point int, x double, y double")
    got = sorted(r.peak_x for r in D.curve_peaks(curve, ["k"], "point", "x", "y").collect())
    assert len(got) == 2 and abs(got[0] - 150) <= 3 and abs(got[1] - 400) <= 5


def test_density_integrates_to_one(rows):
    rng = np.random.default_rng(1)
    values = rng.normal(1000, 100, 2000).round().astype(int)
    counts = rows([("a", int(v)) for v in values], "k string, v bigint").groupBy("k", "v").agg(F.count("*").alias("n"))
    grid = D.kde(counts, ["k"], "v", F.lit(0.0), F.lit(2000.0), 401, 0.1).collect()
    assert sum(r.density for r in grid) * 5 == pytest.approx(1, abs=1e-3)
    whole = D.kde(counts.drop("k"), [], "v", F.lit(0.0), F.lit(2000.0), 401, 0.1).collect()
    assert max(r.density for r in whole) == pytest.approx(max(r.density for r in grid))


def test_smoothing_mirrors_at_nothing_and_has_no_end(rows):
    lengths = [0] * 10 + [14_995] * 10 + [7000] * 30 + [90_000]
    df = rows([("a", n) for n in lengths], "k string, length bigint")
    y = np.zeros(9100)
    for n in lengths:
        y[n // 10] += 1
    w = np.array(D.kernel_weights())
    padded = np.concatenate([y[:12][::-1], y, np.zeros(12)])
    smooth = np.convolve(padded, w, mode="valid")
    got = {r.bin: r.density for r in D.smoothed_histogram(df, ["k"]).collect()}
    for b, v in got.items():
        assert v == pytest.approx(smooth[b // 10] / smooth.max() * 100, abs=1e-6)
    assert len(got) == int((smooth > 0).sum())


def test_isotonic_blocks_are_those_of_plain_pooling(spark, rows):
    random.seed(9)
    data = [(random.random() ** 3, random.randint(0, 1)) for _ in range(3000)] + [(0.25, 1)] * 1500 + [(0.0, 0), (1.0, 1)]
    fit = C.isotonic_fit(rows(data, "p double, err int")).orderBy("lo").collect()
    plain = []
    for p in sorted({p for p, _ in data}):
        hit = [e for q, e in data if q == p]
        plain.append([p, p, len(hit), sum(hit)])
        while len(plain) > 1 and plain[-2][3] * plain[-1][2] >= plain[-1][3] * plain[-2][2]:
            _, hi, n, e = plain.pop()
            plain[-1] = [plain[-1][0], hi, plain[-1][2] + n, plain[-1][3] + e]
    assert [[r.lo, r.hi, r.n, r.errors] for r in fit] == plain
    unseen = [(p,) for p in [-0.5, 0.0, 1e-9, 0.1, 0.25, 0.5, 0.77, 1.0, 1.5]] + [(r.hi + 1e-7,) for r in fit]
    x, y = [v for b in plain for v in b[:2]], [b[3] / b[2] for b in plain for _ in range(2)]
    got = C.isotonic_apply(rows(unseen, "p double"), spark.createDataFrame(fit)).collect()
    assert len(got) == len(unseen)
    for r in got:
        assert r.p_cal == pytest.approx(float(np.interp(r.p, x, y)), abs=1e-9)


def test_isotonic_without_values(rows):
    none = rows([(None, 1), (float("nan"), 0), (0.5, None)], "p double, err int")
    assert C.isotonic_fit(none).count() == 0
    assert [r.p_cal for r in C.isotonic_recalibrate(none).collect()] == [None] * 3
    some = rows([(None, 1), (float("nan"), 0), (0.5, 1), (0.25, 0)], "p double, err int")
    assert sorted((r.p_cal for r in C.isotonic_recalibrate(some).collect()), key=str) == [0.0, 1.0, None, None]


def test_platt_ends_on_separated_flags(rows):
    got = C.platt_recalibrate(rows([(i / 100, int(i > 50)) for i in range(1, 100)], "p double, err int")).collect()
    assert all((r.p_cal > 0.5) == (r.err == 1) for r in got)


def plain_environments(text, kinds, context, core):
    """The blocks by regular expressions, one kind after the other."""
    out = []
    for kind, (o, c) in kinds.items():
        for i, m in enumerate(re.finditer(re.escape(o) + "(.*?)" + re.escape(c), text, re.DOTALL), 1):
            before = text[:m.start()][-context:]
            out.append((kind, i, text[:m.start()].count("\n") + 1, m.group(1).strip(" \t\n\r\f\v"), before, text[m.end():m.end() + context], bool(re.search(core, before))))
    return sorted(out)


def test_environments_against_plain_scans(rows):
    random.seed(3)
    kinds = {"a": ("<a>", "</a>"), "b": ("[b", "b]"), "a*": ("<a*>", "</a*>")}
    parts = [m for pair in kinds.values() for m in pair] + ["\n", " x ", "é", "core", "\\Q"]
    texts = ["", None, "no marks", "<a>", "</a><a></a>", "<a><a*></a></a*>"]
    texts += ["".join(random.choices(parts, k=random.randint(1, 60))) for _ in range(40)]
    texts += ["\n<a>x</a>" * 700, "".join(random.choices(parts, k=4000))]
    docs = rows([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = X.environments(docs, ["id"], "text", kinds, "core", 7).collect()
    for i, t in enumerate(texts):
        mine = sorted((r.kind, r.ordinal, r.line_number, r.content, r.before, r.after, r.is_core) for r in got if r.id == i)
        assert mine == plain_environments(t or "", kinds, 7, "core"), t
    with pytest.raises(ValueError):
        X.environments(docs, ["id"], "text", {"a": ("", "x")})


def test_core_equations_and_nesting(rows):
    text = r"\CEanchor{12}" + "\n" + r"\begin{gather} a \begin{align} b \end{align} \end{gather} and \begin{multline} c"
    got = {r.kind: r for r in X.equations(rows([("d", text)], "doc string, text string"), ["doc"]).collect()}
    assert set(got) == {"gather", "align"} and got["align"].is_core and got["align"].line_number == 2
    assert got["gather"].content.startswith("a \\begin{align}") and got["gather"].after == " and \\begin{multline} c"


def test_lookup_in_text_variant_and_struct(rows):
    docs = rows([('{"a": {"b": {"c": 3}, "d": [1]}}', ({"k": ("v",)},)), ('{"a": 1}', ({},)), ("{", (None,)), (None, None)],
                "j string, s struct<m: map<string, struct<x: string>>>").withColumn("v", F.try_parse_json("j"))
    at = lambda c, path, form="string": [r[0] for r in docs.select(R.lookup(docs, c, path, form)).collect()]
    for c in ("j", "v"):
        assert at(c, "a.b.c", "int") == [3, None, None, None]
        assert at(c, "a.d") == ["[1]", None, None, None]
        assert at(c, "a") == ['{"b":{"c":3},"d":[1]}', "1", None, None]
        assert at(c, "a.b.c.d") == at(c, "z") == [None] * 4
    assert at("s", "m.k.x") == ["v", None, None, None]
    assert at("s", "m.k.y") == at("s", "n") == at("s", "m.k.x.z") == [None] * 4
    assert at("s", "m.k.x", "int") == [None] * 4


def test_batch_filters(rows):
    df = rows([(1, "good", "a", ["x"]), (2, "poor", "a", []), (3, None, "a", None), (4, "poor", "b", None), (5, "poor", "a", ["y"])],
              "id int, completeness_status string, source string, analyses array<string>")
    ids = lambda **f: sorted(r.id for r in R.batch(df, **f).collect())
    assert ids() == [1, 2, 3, 4, 5] and ids(incomplete=True) == [2, 3, 4, 5] and ids(unanalysed=True) == [2, 3, 4]
    assert ids(incomplete=True, unanalysed=True, source="a") == [2, 3] and ids(source="a", limit=2) == [1, 2]


def test_units_near_definitions(rows):
    random.seed(5)
    parts = ["$x$ is the size. ", "$y_{1}$ denotes a rate of bp. ", "$z$ IS é. ", "filler words. ", "a Percentage. ", "of reads. ", "\n"]
    texts = ["", None, "$a$ is b"] + ["".join(random.choices(parts, k=random.randint(1, 80))) for _ in range(30)]
    got = X.variable_definitions(rows([(i, t) for i, t in enumerate(texts)], "id int, text string"), ["id"], context=40).collect()
    for i, t in enumerate(texts):
        plain = []
        for m in re.finditer(r"\$([^$]+)\$\s+(?:represents?|denotes?|is|indicates?)\s+([^.]+)", t or "", re.I):
            near = t[max(0, m.start() - 40):m.end() + 40]
            plain.append((m.group(1), m.group(2).strip(), next((u for p, u in X.UNITS if re.search(p, near, re.I)), None)))
        assert [(r.symbol, r.description.strip(), r.units) for r in sorted(got, key=lambda r: r.ordinal) if r.id == i] == plain
