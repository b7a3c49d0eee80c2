import gzip
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from runqc import session
from runqc.functions import endreason as er
from runqc.operators import endreasons as E
from runqc.operators import reads as R
from runqc.sources import inventory, sequences, summary, writers


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.suffix == ".gz":
        with gzip.open(path, "wt") as f:
            f.write(text)
    else:
        path.write_text(text)
    return str(path)


def test_summaries_with_different_headers(spark, tmp_path):
    a = write(tmp_path / "a.txt", "read_id\tchannel\tsequence_length_template\tmean_qscore_template\tpasses_filtering\tend_reason\talignment_identity\n"
              "r1\t1\t100\t10.5\tTRUE\tsignal_positive\t0.99\nr2\t2\tbad\t9\tFALSE\tx\t-1\nr3\t3\t50\nr4\t4\t70\t8\tpass\t\t*\n")
    b = write(tmp_path / "b.txt", "mean_qscore\tread_length\tread_id\ttime\n7.5\t300\tr5\t12.5\n")
    got = {r.read_id: r for r in summary.canonical_reads(summary.raw_summary(spark, [a, b])).collect()}
    assert set(got) == {"r1", "r4", "r5"}
    assert (got["r1"].length, got["r1"].qscore, got["r1"].passes, got["r1"].alignment_identity) == (100, 10.5, True, 0.99)
    assert (got["r4"].end_reason, got["r4"].alignment_identity, got["r4"].passes) == ("unknown", None, True)
    assert (got["r5"].length, got["r5"].qscore, got["r5"].start_time, got["r5"].channel) == (300, 7.5, 12.5, None)
    kept = summary.canonical_reads(summary.raw_summary(spark, [a]), default_bad=0).where("read_id = 'r2'").first()
    assert kept.length == 0


def test_columns_by_substring(spark, tmp_path):
    path = write(tmp_path / "s.tsv", "my_read_id\tThe_Channel\tend_reason_x\tduration_s\nr1\t7\tData Service\t2.5\nr2\tx\todd\t\n")
    got = summary.end_reason_columns(summary.raw_summary(spark, path)).collect()
    assert [tuple(r) for r in got] == [("r1", 7, "data_service_unblock_mux_change", 2.5), ("r2", 0, "unknown", 0.0)]


def test_key_value_file_keeps_later_equal_signs(spark, tmp_path):
    path = write(tmp_path / "final_summary.txt", "instrument=X1\nprotocol=a=b=c\n\nnonsense\nsample_id = S \n")
    fields = summary.final_summary(spark, path).first()["fields"]
    assert fields == {"instrument": "X1", "protocol": "a=b=c", "sample_id": "S"}


def test_last_line_of_a_repeated_key_wins(spark, tmp_path):
    path = write(tmp_path / "final_summary.txt", "protocol=z\nrun=1\nprotocol=a\nrun=9\nrun=5\n")
    assert summary.final_summary(spark, path).first()["fields"] == {"protocol": "a", "run": "5"}


def test_marks_inside_a_fasta_header(spark, tmp_path):
    path = write(tmp_path / "m.fa", ">a len>5 note\nACGT\n>b x>y\nTT\nGG\n")
    assert sorted(tuple(r) for r in sequences.fasta(spark, path).collect()) == [("a", "ACGT"), ("b", "TTGG")]


@pytest.mark.parametrize("name", ["x.fa", "x.fa.gz"])
def test_fasta(spark, tmp_path, name):
    path = write(tmp_path / name, ">a first one\nACGT\nAC\n>b\nTTTT\n>c\n\n")
    records = sequences.fasta(spark, path)
    assert sorted(tuple(r) for r in records.collect()) == [("a", "ACGTAC"), ("b", "TTTT"), ("c", "")]
    assert tuple(R.fasta_stats(records, []).first()) == (10, 3)


def test_fastq_plain_and_gzip(spark, tmp_path):
    a = write(tmp_path / "fastq_pass" / "a.fastq", "@r1 x\nACGT\n+\n5555\n@r2\nAC\n+\n!!\n")
    b = write(tmp_path / "fastq_fail" / "b.fastq.gz", "@r3\nA\n+\n?\n")
    got = {r.name: r for r in sequences.fastq(spark, [a, b]).collect()}
    assert (got["r1"].length, got["r1"].passes, round(got["r1"].qscore, 6)) == (4, True, 20.0)
    assert (got["r2"].qscore, got["r3"].passes, round(got["r3"].qscore, 6)) == (0.0, False, 30.0)


ODD_FASTQ = b"@r1 first\nACGT\n+\n@@@@\n@r2\n\n+\n\n@r3\r\nAC\r\n+r3\r\n+@\r\n@r4\nA\n+\n@\n@r5 x\nGGTT\n+\n+!!@"


def test_fastq_ranges_at_every_offset():
    """Qualities that start with @ or +, empty reads, other line ends, no last line end: any cut gives the same records."""
    read = lambda at, n: ODD_FASTQ[at:at + n]
    whole = [("r1", "ACGT", "@@@@"), ("r2", "", ""), ("r3", "AC", "+@"), ("r4", "A", "@"), ("r5", "GGTT", "+!!@")]
    for block in (1, 3, 7, 1000):
        assert list(sequences.range_records(read, 0, None, block)) == whole
        for cut in range(1, len(ODD_FASTQ)):
            parts = [list(sequences.range_records(read, a, b, block)) for a, b in ((0, cut), (cut, len(ODD_FASTQ)))]
            assert parts[0] + parts[1] == whole
    for size in range(1, 12):
        assert [r for a in range(0, len(ODD_FASTQ), size) for r in sequences.range_records(read, a, a + size)] == whole


def test_fastq_skips_what_is_no_record():
    broken = b"junk\n\n@cut\nACG\n@r1\nAC\n+\n!!\n\n@r2\nA\n+\n!\n@last\nAC\n+"
    read = lambda at, n: broken[at:at + n]
    assert [r[0] for r in sequences.range_records(read, 0, None)] == ["r1", "r2"]
    assert list(sequences.range_records(lambda at, n: b"", 0, None)) == []


def test_fastq_files_in_ranges(spark, tmp_path):
    (tmp_path / "fastq_pass").mkdir()
    (tmp_path / "fastq_pass" / "a.fastq").write_bytes(ODD_FASTQ)
    write(tmp_path / "fastq_fail" / "b.fq.gz", ODD_FASTQ.decode().replace("@r", "@g"))
    (tmp_path / "fastq_pass" / "notes.txt").write_text("@no\nA\n+\n!\n")
    got = sequences.fastq(spark, [str(tmp_path)], range_bytes=10)
    assert got.rdd.getNumPartitions() > 5
    assert sorted(r.name for r in got.collect()) == ["g1", "g2", "g3", "g4", "g5", "r1", "r2", "r3", "r4", "r5"]
    assert {(r.name[0], r.passes) for r in got.collect()} == {("r", True), ("g", False)}
    whole = sequences.fastq(spark, [f"file://{tmp_path}/fastq_pass/a.fastq"]).collect()
    assert [(r.name, r.length) for r in whole] == [("r1", 4), ("r2", 0), ("r3", 2), ("r4", 1), ("r5", 4)]


@pytest.mark.parametrize("size", [1, 9, 1000])
def test_fastq_text(rows, size):
    texts = rows([("a", ODD_FASTQ.decode()), ("b", ""), ("c", None)], "file string, text string")
    got = sequences.fastq_text(texts, range_bytes=size).collect()
    assert sorted((r.file, r.name, r.seq, r.qual) for r in got) == [("a", "r1", "ACGT", "@@@@"), ("a", "r2", "", ""), ("a", "r3", "AC", "+@"), ("a", "r4", "A", "@"), ("a", "r5", "GGTT", "+!!@")]


def test_sam_text(spark, tmp_path):
    row = "q{i}\t{flag}\tref\t1\t{mapq}\t{cigar}\t*\t0\t0\tACGTACGT\t{qual}\tNM:i:{nm}\n"
    text = "@HD\tVN:1.6\n" + row.format(i=1, flag=0, mapq=60, cigar="4M2I2M1D", qual="55555555", nm=4)
    text += row.format(i=2, flag=4, mapq=0, cigar="*", qual="*", nm=0) + "short\t1\t2\n"
    aln = sequences.sam(spark, write(tmp_path / "a.sam", text))
    got = {r.name: r for r in aln.collect()}
    assert set(got) == {"q1", "q2"} and got["q2"].is_unmapped and got["q2"].qscore is None
    s = R.alignment_statistics(aln.withColumn("k", F.lit(0)), ["k"]).first()
    assert (s["total_records"], s["mapped"], s["primary"], s.insertions_per_read, s.deletions_per_read, s.mismatches_per_read, s.n50) == (2, 1, 1, 2.0, 1.0, 1.0, 8)


def test_side_table_and_documents(spark, tmp_path):
    side = summary.side_table(spark, write(tmp_path / "er.tsv", "read_id\tend_reason\tforced\nr1\tsp\t1\nr2\tub\t\n"))
    assert sorted(tuple(r) for r in side.collect()) == [("r1", "sp", 1), ("r2", "ub", 0)]
    write(tmp_path / "res" / "exp1.json", json.dumps({"total_reads": 5, "end_reasons": {"a": 3, "b": 2}}, indent=1))
    write(tmp_path / "res" / "exp2.json", "{broken")
    docs = summary.result_documents(spark, str(tmp_path / "res"), "total_reads bigint, end_reasons map<string,bigint>")
    got = {r.file: r for r in docs.collect()}
    assert got["exp1"].status == "success" and got["exp2"].status == "error"
    long = docs.where("status = 'success'").select("file", F.explode("end_reasons").alias("end_reason", "n"))
    assert {r.end_reason: r.pct for r in E.totals(long).collect()} == {"a": 60.0, "b": 40.0}


def test_log_statistics(rows):
    lines = rows([("j", 1, "> 10 reads processed"), ("j", 2, "1.5Gbases, 9.5e6"), ("j", 3, "25 reads done"), ("j", 4, "speed 1234.5 samples/s")],
                 "job string, line_no int, value string")
    r = summary.log_statistics(lines, ["job"]).first()
    assert (r.total_reads, r.bases_called, r.samples_per_second) == (25, 1_500_000_000, 1234.5)


def test_inventory_and_discovery(rows):
    paths = ["/d/x/run1/sequencing_summary_a.txt", "/d/x/run1/pod5_pass/a.pod5", "/d/x/run1/fastq_pass/barcode01/a.fastq.gz",
             "/d/y/run2/pod5/a.pod5", "/d/z/loose/only.txt", "/d/x/run3/final_summary_q.txt", "/d/x/run3/bam_pass/a.bam"]
    files = rows([(p, 10) for p in paths], "path string, size bigint")
    inv = {r.run_dir: r for r in inventory.run_inventory(files).collect()}
    assert inv["/d/x/run1"].preferred_source == "sequencing_summary" and inv["/d/x/run1"].pod5_files == 1
    found = {r.run_dir: r.discovery for r in inventory.experiments(files).collect()}
    assert found == {"/d/x/run1": "summary", "/d/y/run2": "raw_only"}


def test_file_listing_does_not_need_content(spark, tmp_path):
    write(tmp_path / "r" / "pod5" / "a.pod5", "x" * 7)
    row = inventory.listing(spark, str(tmp_path / "r")).first()
    assert row["size"] == 7 and row["path"].endswith("a.pod5")


def test_config_tables(spark):
    config = {"targets": {"V1": {"sequence": "ACGT", "expected_length": 4, "size_range": {"min": 3, "max": 5}}},
              "experiments": {"e": {"barcode_mapping": {"barcode01": {"target": "V1", "alias": "first"}}}}}
    assert tuple(inventory.targets_from_config(spark, config).first()) == ("V1", "ACGT", 4, 3, 5, 0)
    assert tuple(inventory.barcodes_from_config(spark, config).first()) == ("e", "barcode01", "V1", "first")


def test_warehouse_upsert_touches_only_its_partitions(spark, rows, tmp_path):
    path = str(tmp_path / "wh")
    schema = "uniq_id string, v int, exp_id string"
    writers.warehouse(rows([("a", 1, "e1"), ("b", 1, "e2")], schema), path)
    writers.warehouse(rows([("a", 2, "e1"), ("c", 2, "e1"), ("c", 2, "e1")], schema), path)
    got = sorted(tuple(r) for r in writers.read_warehouse(spark, path).select("uniq_id", "v", "exp_id").collect())
    assert got == [("a", 2, "e1"), ("b", 1, "e2"), ("c", 2, "e1")]


def test_warehouse_keeps_the_newest_and_does_not_hide_errors(spark, rows, tmp_path):
    path, schema = str(tmp_path / "wh"), "uniq_id string, v int, at int, exp_id string"
    writers.warehouse(rows([("a", 9, 1, "e1"), ("a", 3, 7, "e1"), ("a", 5, 2, "e1")], schema), path, order="at")
    assert [r.v for r in writers.read_warehouse(spark, path).collect()] == [3]
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("no table")
    with pytest.raises(Exception):
        writers.warehouse(rows([("a", 1, 1, "e1")], schema), str(broken))
    assert (broken / "part-0.parquet").read_text() == "no table"


def test_upsert_that_fails_before_its_commit_changes_nothing(spark, rows, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "wh"), "uniq_id string, v int, exp_id string"
    read = lambda: sorted(tuple(r) for r in writers.read_warehouse(spark, path).collect())
    with pytest.raises(FileNotFoundError):
        read()
    writers.warehouse(rows([("a", 1, "007"), ("b", 1, None)], schema), path)
    first = [("a", 1, "007"), ("b", 1, None)]
    assert read() == first
    with monkeypatch.context() as m:
        m.setattr(writers._Files, "commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            writers.warehouse(rows([("a", 2, "007")], schema), path)
    assert read() == first
    late = writers._Files(spark, path)
    writers.warehouse(rows([("a", 3, "007"), ("c", 1, "7")], schema), path)
    assert read() == [("a", 3, "007"), ("b", 1, None), ("c", 1, "7")]
    with pytest.raises(RuntimeError):
        late.commit(2, {})
    assert len(read()) == 3


def test_throughput_points(rows):
    raw = rows([("2024-01-02T03:04:05", "5", "100"), ("2024-01-02 03:09:05", "7", "x"), ("never", "1", "1"), (" 2024-01-02T03:14:05 ", " 9 ", "300")], "timestamp string, reads string, bases string")
    got = summary.throughput(raw).orderBy("ts").collect()
    assert [(str(r.ts), r.cumulative_reads, r.cumulative_bases) for r in got] == [("2024-01-02 03:04:05", 5, 100), ("2024-01-02 03:14:05", 9, 300)]
    assert summary.throughput(raw.select("timestamp")).count() == 3


def test_shared_folder_is_asked_for_on_a_cluster():
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    def fake(master, **conf):
        return SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master, getConf=lambda: Conf()))

    assert session.checkpoint_root(fake("spark://h:7077", **{"spark.checkpoint.dir": "file:/shared"})) == "file:/shared"
    for master in ("spark://h:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            session.checkpoint_root(fake(master))


def test_other_sinks(spark, rows, tmp_path):
    reads = rows([("r1", 1, "signal_positive", 1.5, "BC1", 0)], "read_id string, channel int, end_reason string, duration double, barcode string, barcode_edits int")
    writers.per_read_csv(reads, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["read_id", "channel", "end_reason", "duration"]
    writers.demultiplexed(reads, str(tmp_path / "demux"), str(tmp_path / "summary"))
    assert (tmp_path / "demux" / "barcode=BC1").is_dir()
    assert spark.read.csv(str(tmp_path / "summary"), header=True, sep="\t").count() == 1
    writers.fasta(rows([("a", "ACGT")], "name string, seq string"), str(tmp_path / "fa"))
    assert tuple(sequences.fasta(spark, str(tmp_path / "fa")).first()) == ("a", "ACGT")
    for form in ("csv", "tsv", "json"):
        writers.table(reads, str(tmp_path / form), form)
    writers.summary_json(reads, str(tmp_path / "js"))
    assert spark.read.json(str(tmp_path / "js")).count() == 1


@pytest.mark.parametrize("counts, status", [((499, 501, 0), "FAIL"), ((740, 260, 0), "CHECK"), ((790, 0, 210), "CHECK"), ((900, 100, 0), "OK")])
def test_verdicts_by_hand(rows, counts, status):
    names = ["signal_positive", "mux_change", "signal_negative"]
    data = rows([("e", n) for n, c in zip(names, counts) for _ in range(c)], "exp string, end_reason string")
    r = E.verdicts(data, ["exp"]).first()
    assert r.quality_status == status


def test_end_reason_normalisers(rows):
    df = rows([(1,), (5,)], "c int").select(er.canonical("c").alias("r"))
    assert [r.r for r in df.collect()] == ["signal_positive", "data_service_unblock_mux_change"]
    df = rows([("X signal_positive",), ("Data_Service_UNBLOCK",), ("mux_change",), (None,)], "c string").select(er.category("c").alias("r"))
    assert [r.r for r in df.collect()] == ["signal_positive", "unblock", "mux_change", "other"]
    df = rows([("True ",), ("yes",), ("no",), (None,)], "c string").select(er.passes("c").alias("r"))
    assert [r.r for r in df.collect()] == [True, True, False, False]
    df = rows([("adaptive sampling",), ("mux_change",)], "c string").select(er.coarse_category("c").alias("r"))
    assert [r.r for r in df.collect()] == ["unblock", "other"]


def test_warehouse_folders_are_few_however_many_the_partitions(spark, rows, tmp_path):
    path, schema = str(tmp_path / "wh"), "uniq_id string, v int, exp_id string"
    writers.warehouse(rows([(f"k{i}", 1, f"e{i % 600}") for i in range(1200)], schema), path)
    writers.warehouse(rows([(f"k{i}", 2, f"e{i % 600}") for i in range(0, 1200, 3)] + [("k1", 3, "e0")], schema), path)
    want = [(f"k{i}", 2 if i % 3 == 0 else 1, f"e{i % 600}") for i in range(1200)] + [("k1", 3, "e0")]
    assert sorted(tuple(r) for r in writers.read_warehouse(spark, path).collect()) == sorted(want)
    assert len(writers._Files(spark, path).manifest()[1]) <= writers.BUCKETS
    assert len(list((tmp_path / "wh").rglob("*.parquet"))) <= 2 * writers.BUCKETS


def test_warehouse_with_a_folder_for_each_partition_is_brought_into_form(spark, rows, tmp_path):
    path, schema = str(tmp_path / "wh"), "uniq_id string, v int, exp_id string"
    rows([("a", 1, "e1", "p_e1"), ("b", 1, "e2", "p_e2")], schema + ", _part string").write.partitionBy("_part").parquet(f"{path}/data/old")
    files = writers._Files(spark, path)
    files.commit(1, {name: "data/old" for name in files.folders("data/old")})
    writers.warehouse(rows([("a", 2, "e1")], schema), path)
    assert sorted(tuple(r) for r in writers.read_warehouse(spark, path).collect()) == [("a", 2, "e1"), ("b", 1, "e2")]
    assert all("=b_" in name for name in writers._Files(spark, path).manifest()[1])
