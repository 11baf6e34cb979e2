"""File formats and commands, end to end."""

import json
import subprocess
import sys

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from genoloom import cli
from genoloom.model import InvariantBroken, IOFailed, UsageFailed
from genoloom.plans import commands
from genoloom.sources import genotypes as gt
from genoloom.sources import pgen
from genoloom.sources import text
from genoloom.sources.afs import load_afs
from genoloom.sources.detect import detect, strip_known_suffix
from genoloom.sources.panels import read_panel
from genoloom.sources.sidecar import read_sidecar

from .panels import panel, write_pfile, write_variants


def _matrix(frame):
    return np.array([[-9 if x is None else x for x in r.g] for r in frame.orderBy("row_idx").collect()])


def test_prefixes(tmp_path):
    assert strip_known_suffix("a/b.pvar.zst") == "a/b"
    assert strip_known_suffix("a/b.bed") == "a/b"
    assert strip_known_suffix("a/b.vcf") == "a/b.vcf"
    with pytest.raises(UsageFailed):
        detect(str(tmp_path / "none"))
    (tmp_path / "x.pgen").write_bytes(b"")
    with pytest.raises(UsageFailed):
        detect(str(tmp_path / "x"))


def test_row_numbers_follow_the_file_over_many_splits(spark, tmp_path):
    path = tmp_path / "many.txt"
    path.write_text("#h\n" + "".join(f"line{k}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = text.numbered_lines(spark, str(path), ~F.col("value").startswith("#")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r.row_idx: r.value for r in rows} == {k: f"line{k}" for k in range(5000)}


def test_variant_text(spark, tmp_path):
    path = str(tmp_path / "p.pvar")
    with open(path, "w") as f:
        f.write("##x\n#CHROM\tPOS\tID\tREF\tALT\tCM\nchr1\t5\ta\tA\tC\t1.5\nbad\t6\tb\tAT\tA\t0\nX\t7\tc\ta\tg\t0\nX\t8\td\tG\tT\tNaN\n")
    rows = text.snp_table(text.variant_cells(spark, path), path).orderBy("row_idx").collect()
    assert [tuple(r) for r in rows] == [(0, 1, 5, "a", "A", "C", 1.5), (3, 23, 8, "d", "G", "T", 0.0)]
    with open(path, "a") as f:
        f.write("bad\t9\te\tA\tC\t0\n")
    with pytest.raises(InvariantBroken, match="bad"):
        text.snp_table(text.variant_cells(spark, path), path)
    with open(path, "w") as f:
        f.write("1\t5\ta\tA\tC\n")
    with pytest.raises(IOFailed):
        text.variant_cells(spark, path)


def test_zstd_variants(spark, tmp_path):
    prefix = str(tmp_path / "z")
    write_variants(prefix, [(1, 5, "a", "A", "C"), (2, 6, "b", "G", "T")])
    raw = open(f"{prefix}.pvar", "rb").read()
    (tmp_path / "z.pvar.zst").write_bytes(zstandard.compress(raw))
    a, b = text.variant_cells(spark, f"{prefix}.pvar").collect(), text.variant_cells(spark, f"{prefix}.pvar.zst").collect()
    assert sorted(a) == sorted(b) and len(a) == 2


@pytest.mark.parametrize("samples", [1, 4, 5, 9])
def test_pgen_round_trip(spark, tmp_path, samples):
    prefix, rows, _, g = panel(str(tmp_path / "a"), 37, samples, seed=samples)
    where = gt.layout(f"{prefix}.pgen", len(rows), samples)
    assert (_matrix(gt.read_binary(spark, where)) == g).all()


def test_bed_and_packed_eigenstrat_codes(spark, tmp_path):
    bed = tmp_path / "x.bed"
    bed.write_bytes(b"\x6c\x1b\x01" + bytes([0b11_10_01_00, 0b00_00_00_11]))  # samples 0..3: codes 0 1 2 3; sample 4: code 3
    assert _matrix(gt.read_binary(spark, gt.layout(str(bed), 1, 5))).tolist() == [[2, -9, 1, 0, 0]]
    geno = tmp_path / "x.geno"
    width = 48
    geno.write_bytes(b"GENO       5       1 0 0".ljust(width, b"\0") + bytes([0b00_01_10_11, 0b10_000000]).ljust(width, b"\0"))
    assert _matrix(gt.read_binary(spark, gt.layout(str(geno), 1, 5))).tolist() == [[2, 1, 0, -9, 0]]


def _difflist(places, codes, n_samples):
    """A list of differences, as the format describes it."""
    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    out, n = varint(len(places)), len(places)
    if not n:
        return out
    width = (n_samples.bit_length() + 7) // 8
    groups = [places[k : k + 64] for k in range(0, n, 64)]
    deltas = [b"".join(varint(b - a) for a, b in zip(g, g[1:])) for g in groups]
    out += b"".join(int(g[0]).to_bytes(width, "little") for g in groups) + bytes(len(d) - 63 for d in deltas[:-1])
    packed = np.zeros(-(-n // 4) * 4, np.uint8)
    packed[:n] = codes
    packed = packed.reshape(-1, 4)
    return out + bytes(packed[:, 0] | packed[:, 1] << 2 | packed[:, 2] << 4 | packed[:, 3] << 6) + b"".join(deltas)


def _variable_pgen(path, g, kinds, type_bits=4, length_bytes=2):
    """A file with a record of the wanted type for each row of g (codes 0 to 3)."""
    n_variants, n = g.shape
    base, records = None, []
    for row, kind in zip(g, kinds):
        if kind & 7 == 0:
            raw = np.zeros(-(-n // 4) * 4, np.uint8)
            raw[:n] = row
            raw = raw.reshape(-1, 4)
            body = bytes(raw[:, 0] | raw[:, 1] << 2 | raw[:, 2] << 4 | raw[:, 3] << 6)
        elif kind & 7 == 1:
            other = np.flatnonzero(row > 1)
            body = bytes([1]) + np.packbits((row == 1).astype(np.uint8), bitorder="little").tobytes() + _difflist(other.tolist(), row[other], n)
        else:
            if kind & 7 in (2, 3):
                common = base
                row = np.array([2, 1, 0, 3])[row] if kind & 7 == 3 else row
            else:
                common = np.full(n, kind & 3)
            other = np.flatnonzero(row != common)
            body = _difflist(other.tolist(), row[other], n)
        if kind & 7 not in (2, 3):
            base = row
        records.append(body + (b"tail" if kind & 16 else b""))
    types = np.array(kinds, np.uint8)
    halves = [*kinds, 0]
    packed = types.tobytes() if type_bits == 8 else bytes(halves[k] | halves[k + 1] << 4 for k in range(0, len(kinds), 2))
    lengths = b"".join(len(r).to_bytes(length_bytes, "little") for r in records)
    form = (4 if type_bits == 8 else 0) + length_bytes - 1 + 64
    start = 12 + 8 + len(packed) + len(lengths)
    path.write_bytes(b"\x6c\x1b\x10" + np.array([n_variants, n], "<u4").tobytes() + bytes([form]) + start.to_bytes(8, "little") + packed + lengths + b"".join(records))


@pytest.mark.parametrize(("samples", "bits", "size"), [(1, 4, 1), (70, 4, 2), (300, 8, 3), (5, 8, 4)])
def test_variable_width_pgen(spark, tmp_path, samples, bits, size):
    rng = np.random.default_rng(samples)
    kinds = [0, 2, 3, 1, 2, 4, 3, 6, 7, 2, 0, 3, 3, 1, 6, 2] * 2
    if bits == 8:
        kinds[3], kinds[8], kinds[10] = 16 + 1, 16 + 7, 32 + 16
    g = np.array([rng.choice(4, samples, p=p) for p in ([0.7, 0.2, 0.05, 0.05], [0.1, 0.2, 0.6, 0.1], [0.02, 0.02, 0.01, 0.95], [0.25] * 4) * 8])
    path = tmp_path / "v.pgen"
    _variable_pgen(path, g, kinds, bits, size)
    want = np.where(g == 3, -9, g)
    where = gt.layout(str(path), len(g), samples)
    assert (_matrix(gt.read_binary(spark, where)) == want).all()
    for first in range(0, len(g), 5):  # any range by itself, with the base that its differences need
        got = np.concatenate([x for _, x in pgen.read_rows(str(path), first, len(g), 3)])
        assert (got == want[first:]).all()
    with pytest.raises(IOFailed, match="samples"):
        gt.layout(str(path), len(g), samples + 1)


def test_unknown_pgen_is_refused(tmp_path):
    path = tmp_path / "c.pgen"
    path.write_bytes(b"\x6c\x1b\x20" + bytes(100))
    with pytest.raises(IOFailed, match="0x20"):
        gt.layout(str(path), 3, 3)


def _eigenstrat(tmp_path, lines):
    (tmp_path / "e.ind").write_text("s0 M P\ns1 F P\ns2 U Q\n")
    (tmp_path / "e.snp").write_text("a 1 0.0 10 A C\nb 23 0.0 20 A G\nc 2 0.5 30 G T\n")
    (tmp_path / "e.geno").write_text("".join(x + "\n" for x in lines))
    return str(tmp_path / "e")


def test_ascii_eigenstrat(spark, tmp_path):
    p = read_panel(spark, _eigenstrat(tmp_path, ["012", "999", "209"]))
    assert [(r.row_idx, r.chrom, r.cm) for r in p.variants.orderBy("row_idx").collect()] == [(0, 1, 0.0), (2, 2, 0.5)]
    assert _matrix(p.dosages).tolist() == [[2, 1, 0], [-9, -9, -9], [0, 2, -9]]
    assert [(r.IID, r.SEX, r.POP) for r in p.samples.orderBy("sample_ord").collect()] == [("s0", "1", "P"), ("s1", "2", "P"), ("s2", "0", "Q")]


def test_ascii_eigenstrat_size(spark, tmp_path):
    with pytest.raises(IOFailed):
        read_panel(spark, _eigenstrat(tmp_path, ["012", "99", "209"]))


@pytest.mark.parametrize("value", ["true", "1.0", '"1"', "2", "null"])
def test_sidecar_is_strict(tmp_path, value):
    prefix = str(tmp_path / "s")
    (tmp_path / "s.pseudohaploid.json").write_text('{"schema_version": 1, "samples": {"a": {"pseudohaploid": %s}}}' % value)
    with pytest.raises(InvariantBroken):
        read_sidecar(prefix)
    (tmp_path / "s.pseudohaploid.json").write_text('{"schema_version": 1, "samples": {"a": {"pseudohaploid": 0}}}')
    assert read_sidecar(prefix) == {"a": 0}
    assert read_sidecar(str(tmp_path / "other")) == {}


def test_merge_places_swaps_and_fills(spark, tmp_path):
    """Indels between SNPs: genotypes go by the row number of the file."""
    a_rows = [(1, 10, "a", "A", "C"), (1, 15, "i", "AT", "A"), (1, 20, "b", "A", "G"), (2, 5, "c", "A", "T"), (2, 9, "d", "G", "T")]
    b_rows = [(1, 3, "j", "AT", "A"), (1, 10, "a", "C", "A"), (1, 20, "b", "T", "C"), (2, 5, "c", "A", "T")]
    a = write_pfile(str(tmp_path / "a"), a_rows, ["s0", "s1"], [[0, 1], [2, 2], [1, 2], [0, 0], [2, -9]])
    b = write_pfile(str(tmp_path / "b"), b_rows, ["t0"], [[1], [0], [2], [1]], extra=("ZED", "q"))
    out = str(tmp_path / "out" / "m")
    document = commands.merge(spark, [a, b], out, report=f"{out}.tsv", report_json=f"{out}.json", quiet=True, policy=commands.Policy(validate_strand_fail_pct=50))
    got = read_panel(spark, out)
    assert _matrix(got.dosages).tolist() == [[0, 1, 2], [1, 2, 2], [2, -9, -9]]
    assert open(f"{out}.pvar").read() == "#CHROM\tPOS\tID\tREF\tALT\tCM\n1\t10\ta\tA\tC\t0.0\n1\t20\tb\tA\tG\t0.0\n2\t9\td\tG\tT\t0.0\n"
    assert open(f"{out}.psam").read().splitlines()[0] == "#FID\tIID\tSEX\tPOP\tPSEUDOHAPLOID\tZED"
    assert open(f"{out}.psam").read().splitlines()[3].split("\t")[-1] == "q"
    assert open(f"{out}.tsv").read() == "variant_id\tchr\tpos\tinput_index\taction\treason\na\t1\t10\t1\tref_alt_swap\t\nb\t1\t20\t1\tstrand_flip\t\nc\t2\t5\t1\tdrop\tambiguous_strand\nd\t2\t9\t1\tfill_missing\t\n"
    assert json.load(open(f"{out}.json")) == json.loads(json.dumps(document))
    assert document["inputs"][0]["n_variants"] == 5 and document["output"]["n_variants"] == 3


def test_merge_is_associative(spark, tmp_path):
    a, b, c = (panel(str(tmp_path / x), 20, 3, seed=k)[0] for k, x in enumerate("abc"))
    commands.merge(spark, [a, b, c], str(tmp_path / "abc"), quiet=True)
    commands.merge(spark, [a, b], str(tmp_path / "ab"), quiet=True)
    commands.merge(spark, [str(tmp_path / "ab"), c], str(tmp_path / "ab_c"), quiet=True)
    for x in (".pgen", ".pvar"):
        assert (tmp_path / f"abc{x}").read_bytes() == (tmp_path / f"ab_c{x}").read_bytes()


def test_failed_gate_leaves_no_output(spark, tmp_path):
    a, rows, _, _ = panel(str(tmp_path / "a"), 20, 2)
    b = write_pfile(str(tmp_path / "b"), rows, ["t"], np.full((20, 1), -9))
    out = str(tmp_path / "m")
    assert cli.run(["merge", a, "--target", b, "-o", out, "--quiet"], spark) == 1
    assert not (tmp_path / "m.pgen").exists() and not list(tmp_path.glob("*.part*"))
    assert cli.run(["merge", a, "--target", b, "-o", out, "--quiet", "--target-min-call-rate", "0"], spark) == 0


def test_exit_codes(spark, tmp_path, capsys):
    a, rows, _, _ = panel(str(tmp_path / "a"), 20, 2)
    b, *_ = panel(str(tmp_path / "b"), 20, 2, start=500)
    assert cli.run(["merge", a, "-o", str(tmp_path / "x")], spark) == 4
    assert cli.run(["merge", a, str(tmp_path / "none"), "-o", str(tmp_path / "x")], spark) == 4
    assert cli.run(["validate", a, b, "--preflight-policy", "strict"], spark) == 1
    assert cli.run(["validate", a, b, "--no-population-column", "--population-column", "Q"], spark) == 4
    assert cli.run(["merge", a, a, "-o", str(tmp_path / "x"), "--quiet"], spark) == 3
    assert cli.run(["validate", a, a, "--on-collision", "suffix", "--quiet"], spark) == 0
    (tmp_path / "a.pgen").write_bytes(b"nothing")
    assert cli.run(["validate", a, b], spark) == 2
    assert cli.run(["dance"], spark) == 4


def test_strict_preflight_removes_an_older_output(spark, tmp_path):
    a, *_ = panel(str(tmp_path / "a"), 20, 2)
    b, *_ = panel(str(tmp_path / "b"), 20, 2, start=500)
    out = tmp_path / "m.pgen"
    out.write_bytes(b"old")
    assert cli.run(["merge", a, b, "-o", str(tmp_path / "m"), "--preflight-policy", "strict", "--quiet"], spark) == 1
    assert not out.exists() and (tmp_path / "m.preflight.json").exists()


def test_lock(spark, tmp_path):
    from genoloom.sources.sinks import output_lock

    with output_lock(str(tmp_path / "m")), pytest.raises(IOFailed), output_lock(str(tmp_path / "m")):
        pass
    assert (tmp_path / "m.lock").exists()


def test_afs_files(spark, tmp_path):
    rows = [(1, 10, "a", "A", "C"), (1, 20, "b", "A", "G"), (23, 5, "x", "A", "C")]
    prefix = write_pfile(str(tmp_path / "a"), rows, ["s0", "s1", "s2"], [[0, 1, 2], [-9, -9, 1], [2, 2, 2]], ["P", "P", "Q"])
    (tmp_path / "a.pseudohaploid.json").write_text('{"schema_version": 1, "samples": {"s2": {"pseudohaploid": 1}}}')
    commands.afs(spark, prefix, str(tmp_path / "o"), quiet=True)
    assert (tmp_path / "o" / "afs_freq.tsv").read_text() == "variant_id\tP\tQ\na\t0.25\t1\nb\tnan\t0.5\n"
    assert (tmp_path / "o" / "afs_counts.tsv").read_text() == "variant_id\tP\tQ\na\t4\t1\nb\t0\t1\n"
    manifest = json.loads((tmp_path / "o" / "afs_manifest.json").read_text())
    assert (tmp_path / "o" / "afs_snp.tsv").read_text() == "variant_id\tchrom\tpos\tref\talt\tcm\na\t1\t10\tA\tC\t0.0\nb\t1\t20\tA\tG\t0.0\n"
    loaded = load_afs(spark, str(tmp_path / "o"))
    assert loaded.manifest == manifest and [tuple(r) for r in loaded.snp.orderBy("pos").collect()] == [("a", 1, 10, "A", "C", 0.0), ("b", 1, 20, "A", "G", 0.0)]
    assert sorted(map(tuple, loaded.long().collect()), key=str) == [("a", "P", 0.25, 4), ("a", "Q", 1.0, 1), ("b", "P", None, 0), ("b", "Q", 0.5, 1)]
    assert manifest["n_variants"] == 2 and manifest["adjust_pseudohaploid_applied"] and manifest["populations"] == ["P", "Q"]
    with pytest.raises(InvariantBroken):
        commands.afs(spark, prefix, str(tmp_path / "o"), populations=["Z"], quiet=True)


def test_hash_does_not_depend_on_ids_or_order(spark, tmp_path, capsys):
    rows = [(1, 10, "a", "A", "C"), (1, 20, "b", "A", "G")]
    a = write_pfile(str(tmp_path / "a"), rows, ["s"], [[0], [1]])
    b = write_pfile(str(tmp_path / "b"), [(1, 20, "q", "A", "G"), (1, 10, "r", "A", "C")], ["s"], [[0], [1]])
    assert commands.hash_variants(spark, a) == commands.hash_variants(spark, b)
    capsys.readouterr()
    commands.hash_variants(spark, a, emit_canonical=True)
    assert capsys.readouterr().out == "1\t10\tA\tC\n1\t20\tA\tG\n"


def test_inspect(spark, tmp_path):
    a, *_ = panel(str(tmp_path / "a"), 20, 4)
    summary = commands.inspect(spark, a)
    assert list(summary) == ["input_path", "format", "n_samples", "n_variants_pre_filter", "n_variants_post_filter_biallelic_snp", "n_populations", "populations", "sex_distribution", "variants_per_chrom", "missingness_histogram"]
    assert summary["populations"] == {"pop0": 2, "pop1": 1, "pop2": 1} and summary["variants_per_chrom"] == {1: 10, 2: 10}
    assert sum(summary["missingness_histogram"]["bins"].values()) == 4
    assert "populations:\n  pop0\t2" in commands.inspect_text(summary)


def test_more_than_two_alleles(spark, tmp_path):
    rows = [(1, 10, "a", "A", "C"), (1, 20, "b", "A", "G,T"), (2, 5, "c", "A", "C")]
    a = write_pfile(str(tmp_path / "a"), rows, ["s0", "s1"], [[0, 1], [2, 2], [1, 2]])
    b, *_ = panel(str(tmp_path / "b"), 20, 2)
    assert cli.run(["merge", a, b, "-o", str(tmp_path / "m"), "--quiet"], spark) == 3
    summary = commands.inspect(spark, a)
    assert summary["missingness_histogram"]["status"] == "skipped" and "3 alleles" in summary["missingness_histogram"]["reason"]
    assert summary["n_variants_post_filter_biallelic_snp"] == 2 and "skipped: " in commands.inspect_text(summary)


def test_inspect_of_unlike_files(spark, tmp_path):
    a, rows, _, _ = panel(str(tmp_path / "a"), 20, 2)
    write_variants(a, rows[:-1])
    assert commands.inspect(spark, a)["missingness_histogram"]["status"] == "skipped"
    assert cli.run(["validate", a, a, "--on-collision", "suffix", "--quiet"], spark) == 3


def test_extras_are_dropped_without_a_word(spark, tmp_path, capsys):
    rows = [(1, 10 * k, f"v{k}", "A", "C") for k in range(1, 21)]
    a = write_pfile(str(tmp_path / "a"), rows[:5], ["s"], [[1]] * 5)
    b = write_pfile(str(tmp_path / "b"), rows, ["t"], [[1]] * 20)
    assert cli.run(["merge", a, b, "-o", str(tmp_path / "m"), "--quiet"], spark) == 1
    assert cli.run(["merge", a, b, "-o", str(tmp_path / "m"), "--on-extra", "drop"], spark) == 0
    assert "warning" not in capsys.readouterr().err.lower()
    assert read_panel(spark, str(tmp_path / "m")).variants.count() == 5


def test_validate_report_with_rows(spark, tmp_path):
    a, *_ = panel(str(tmp_path / "a"), 20, 2)
    path = str(tmp_path / "r.json")
    assert cli.run(["validate", a, a, "--on-collision", "suffix", "--quiet", "--report-json", path, "--report-json-include-rows"], spark) == 0
    assert len(json.load(open(path))["variants"]) == 20
    assert cli.run(["validate", a, a, "--report-json-include-rows"], spark) == 4


def test_parquet_output_is_staged(spark, tmp_path):
    a, *_ = panel(str(tmp_path / "a"), 20, 2, seed=1)
    b, *_ = panel(str(tmp_path / "b"), 20, 2, seed=2)
    document = commands.merge(spark, [a, b], str(tmp_path / "m"), parquet=True, quiet=True)
    assert spark.read.parquet(f"{tmp_path}/m.parquet").count() == document["output"]["n_variants"]
    assert document["output"]["paths"]["parquet"].endswith("m.parquet") and not list(tmp_path.glob("*.part*"))


def test_network_filesystems_are_told(tmp_path):
    from genoloom.sources.sinks import human_bytes, network_filesystem

    mounts = tmp_path / "mounts"
    mounts.write_text(f"1 0 0:1 / / rw - ext4 /dev/x rw\n2 1 0:2 / {tmp_path} rw - nfs4 server:/x rw\n")
    assert network_filesystem(str(tmp_path / "out"), str(mounts)) == "nfs4"
    assert network_filesystem("/other/out", str(mounts)) is None
    assert [human_bytes(n) for n in (0, 1023, 1024, 5 << 20, 3 << 30, 7 << 40)] == ["0 B", "1,023 B", "1.0 KB", "5.0 MB", "3.0 GB", "7 TB"]


def test_module_runs():
    done = subprocess.run([sys.executable, "-m", "genoloom", "merge"], capture_output=True, text=True, cwd=str(cli.__file__).rsplit("/genoloom/", 1)[0])
    assert done.returncode == 4 and "error" in done.stderr


def test_streaming_counters(spark, tmp_path):
    from genoloom.streaming.counters import SHARD, running_counters, stream_shards

    shards = spark.createDataFrame([(0, 1, [0, 1, None]), (1, 23, [1, 1, 1]), (2, 2, [1, 1, 2])], SHARD)
    shards.write.parquet(str(tmp_path / "in"))
    job = running_counters(stream_shards(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counters").outputMode("complete").trigger(availableNow=True).start()
    job.awaitTermination(60)
    got = {tuple(r) for r in spark.table("counters").collect()}
    assert got == {tuple(r) for r in running_counters(shards).collect()} == {(0, 1, 2), (1, 2, 2), (2, 0, 1)}
