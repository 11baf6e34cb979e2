"""The panel queries by name, each over the derived panels of :mod:`genoloom.fixtures`."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .catalogue_sql import SQL
from .functions import cells
from .functions.alleles import chromosome, complement, is_ambiguous, is_snp, is_swap
from .model import AUTOSOMES, Policy
from .operators import alignment as al
from .operators import binding as bi
from .operators import fingerprint as fi
from .operators import frequencies as fr
from .operators import gates as ga
from .operators import identity as id_
from .operators import inspection as ins
from .operators import preflight as pf

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _aligned(s: SparkSession, d: str, policy: Policy | None = None, with_target: bool = False) -> DataFrame:
    others = [fx.variants_b(s, d)] + ([fx.variants_a(s, d)] if with_target else [])
    return al.align(fx.variants_a(s, d), others, policy or Policy())


def _actions(alignment: DataFrame) -> DataFrame:
    return alignment.select("variant_id", "chrom", "pos", "input_idx", "action", F.coalesce("reason", F.lit("")).alias("reason"))


@query
def scan_variants_snp_filter(s, d):
    raw = fx.variants_raw(s, d)
    return raw.where(is_snp(F.col("ref"), F.col("alt"))).select("chrom", "pos", "id", "ref", "alt", "row_idx")


@query
def chrom_normalize(s, d):
    k = F.col("row_idx")
    label = F.when(k % 7 == 0, F.concat(F.lit("chr"), F.col("chrom").cast("string"))).when(k % 7 == 1, F.lit("chrX")).when(k % 7 == 2, F.lit(" mt ")).when(k % 7 == 3, F.lit("CHRy")).when(k % 7 == 4, F.concat(F.lit("scaffold"), F.col("chrom").cast("string"))).when(k % 7 == 5, (F.col("chrom") + 10).cast("string")).otherwise(F.lit("M"))
    return fx.variants_raw(s, d).select("row_idx", label.alias("raw"), chromosome(label).alias("chrom"))


@query
def allele_complement(s, d):
    rows = fx.variants_a(s, d).select("ref", "alt").distinct()
    return rows.select("ref", "alt", complement(F.col("ref")).alias("cref"), complement(F.col("alt")).alias("calt"), is_ambiguous(F.col("ref"), F.col("alt")).alias("ambiguous"))


@query
def align_actions_chr_pos(s, d):
    return _actions(_aligned(s, d))


@query
def align_actions_id(s, d):
    named = F.col("id") != "."
    return _actions(al.align(fx.variants_a(s, d).where(named), [fx.variants_b(s, d).where(named)], Policy(variant_key="id")))


@query
def align_trust_strand(s, d):
    return _actions(_aligned(s, d, Policy(trust_strand=True)))


@query
def align_on_missing_drop(s, d):
    return _actions(_aligned(s, d, Policy(on_missing="drop_variant")))


@query
def align_on_strand_drop(s, d):
    return _actions(_aligned(s, d, Policy(on_strand="drop")))


@query
def align_action_histogram(s, d):
    return al.histogram(_aligned(s, d))


@query
def align_action_histogram_strict(s, d):
    return al.histogram(_aligned(s, d, Policy(on_strand="drop", on_missing="drop_variant")))


@query
def align_action_histogram_per_chrom(s, d):
    return al.histogram_by_chromosome(_aligned(s, d))


@query
def align_tally(s, d):
    return al.tally(_aligned(s, d, with_target=True)).withColumn("reason", F.coalesce("reason", F.lit("")))


@query
def align_kept_variants(s, d):
    return al.kept(_aligned(s, d, with_target=True)).select("chrom", "pos", "variant_id")


@query
def align_kept_count(s, d):
    return al.kept(_aligned(s, d)).agg(F.count("*").alias("n"))


@query
def align_intersection_size(s, d):
    return al.intersection_size(_aligned(s, d))


@query
def align_extras(s, d):
    a = fx.variants_a(s, d)
    return al.extras(a, [fx.variants_b(s, d), fx.variants_c(s, d)], Policy())


@query
def report_rows(s, d):
    return al.report_rows(_aligned(s, d, with_target=True)).drop("canonical_row")


@query
def gate_extras(s, d):
    a, policy = fx.variants_a(s, d), Policy()
    return ga.extras_gate(a, al.extras(a, [fx.variants_b(s, d), fx.variants_c(s, d)], policy), policy)


@query
def gate_ambiguous(s, d):
    return ga.ambiguous_gate(_aligned(s, d), Policy(validate_strand_fail_pct=5.0))


def _to_bind(s: SparkSession, d: str):
    panels = fx.panels(s, d)
    alignment = _aligned(s, d, with_target=True)
    plan = id_.identity_plan(panels, Policy(on_collision="suffix"))
    return panels, alignment, al.kept(alignment), plan


def _counters(s: SparkSession, d: str):
    panels, alignment, kept, plan = _to_bind(s, d)
    return panels, plan, bi.panel_counters(panels, alignment, kept, plan)


@query
def gate_target_call_rate(s, d):
    panels, plan, counters = _counters(s, d)
    targets = plan.where("input_idx = 2").select(F.col("iid_out").alias("iid"))
    return ga.call_rate_gate(counters, targets, panels[0].variants.count(), Policy())


@query
def gate_soft_errors(s, d):
    policy = Policy(on_mismatch="error", on_missing="error", on_extra="error", on_strand="error")
    a, others = fx.variants_a(s, d), [fx.variants_b(s, d)]
    extra = al.extras(a, others, policy).agg(F.sum("extras").alias("x")).first().x
    counts = al.policy_triggers(al.align(a, others, policy), int(extra), policy)
    return s.createDataFrame([(k, v, v > 0) for k, v in counts.items()], "policy string, n long, fires boolean")


def _ids(s: SparkSession, d: str) -> DataFrame:
    return id_.identities(fx.panels(s, d, False))


@query
def iid_collisions(s, d):
    return id_.collisions(_ids(s, d))


@query
def iid_first(s, d):
    return id_.first_wins(_ids(s, d))


@query
def iid_suffix_simple(s, d):
    return id_.identity_plan(fx.panels(s, d, False), Policy(on_collision="suffix"))


def _pairs(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(0, "POP0", "WEST"), (1, "POP1", "EAST"), (2, "POP0", "NORTH")], "line_no long, input string, output string")


@query
def relabel_two_col(s, d):
    rows = fx.samples(s, d, 0).withColumn("old", F.col("POP"))
    return id_.relabel(rows, _pairs(s), "POP").select(F.col("IID").alias("iid"), F.col("old").alias("pop_before"), F.col("POP").alias("pop_after"))


@query
def relabel_by_id(s, d):
    rows = fx.samples(s, d, 0).withColumn("old", F.col("POP"))
    pairs = rows.where("sample_ord % 3 = 0").select(F.col("sample_ord").alias("line_no"), F.col("IID").alias("input"), F.concat(F.lit("G"), (F.col("sample_ord") % 2).cast("string")).alias("output"))
    return id_.relabel(rows, pairs, "IID").select(F.col("IID").alias("iid"), F.col("old").alias("pop_before"), F.col("POP").alias("pop_after"))


@query
def sample_union(s, d):
    panels = [p.with_(samples=id_.family_from_population(p.samples)) for p in fx.panels(s, d, False)]
    out = id_.sample_union(panels, id_.identity_plan(panels, Policy(on_collision="first")))
    return out.select("out_ord", F.col("FID").alias("fid"), F.col("IID").alias("iid"), F.col("SEX").alias("sex"), F.col("POP").alias("pop"), F.coalesce("REGION", F.lit("NA")).alias("extra"))


@query
def dosage_swap(s, d):
    rows = _aligned(s, d).where(is_swap(F.col("action"))).select("variant_id", "canonical_row", "other_row")
    form = fx.packed(s, d, 1)
    every = list(range(form.width))
    joined = rows.join(form.rows, F.col("other_row") == F.col("row_idx")).select("canonical_row", *form.payload, F.lit(True).alias("swap"))
    g = cells.unpacked(joined, [(form, form.payload, every, every, "swap")], form.width)
    return g.select("canonical_row", F.posexplode("g").alias("sample_ord", "g")).withColumn("g", F.col("g").cast("int"))


@query
def bind_long(s, d):
    return bi.long_dosages(bi.bind(*_to_bind(s, d))).select("chrom", "pos", F.col("out_ord").cast("long").alias("out_ord"), F.col("g").cast("int").alias("g"))


@query
def bind_sample_counters(s, d):
    _, plan, counters = _counters(s, d)
    return counters.select("iid", "het", "called")


@query
def pseudohap_status(s, d):
    _, plan, counters = _counters(s, d)
    return bi.statuses(counters).select("iid", "status")


@query
def pseudohap_mix(s, d):
    _, plan, counters = _counters(s, d)
    return bi.status_mix(bi.statuses(counters))


@query
def pseudohap_sidecar(s, d):
    _, plan, counters = _counters(s, d)
    given = plan.where("input_idx = 0 and sample_ord % 2 = 0").select(F.col("iid_out").alias("iid"), F.when(F.col("sample_ord") % 4 == 0, "1").otherwise("0").alias("status"))
    return bi.statuses(counters, given).select("iid", "status")


def _afs(s, d, adjust: bool, names=None, chromosomes=AUTOSOMES) -> DataFrame:
    panel = fx.panels(s, d, False)[0]
    places = fr.population_places(panel.samples, names, fr.haploid_flags(panel))
    return fr.frequencies(panel.variants, fx.packed(s, d, 0), places, adjust, chromosomes)


def _afs_columns(rows: DataFrame) -> DataFrame:
    return rows.select("chrom", "pos", "pop", "alt_count", "called", "freq")


@query
def afs_diploid(s, d):
    return _afs_columns(_afs(s, d, False))


@query
def afs_pseudohap_adjusted(s, d):
    return _afs_columns(_afs(s, d, True))


@query
def afs_population_subset(s, d):
    names = [r.POP for r in fx.samples(s, d, 0).select("POP").distinct().orderBy(F.desc("POP")).limit(2).collect()]
    return _afs_columns(_afs(s, d, True, names))


@query
def afs_sex_chrom(s, d):
    return _afs_columns(_afs(s, d, True, chromosomes=range(1, 27)))


@query
def afs_pivot_counts(s, d):
    names = [r.POP for r in fx.samples(s, d, 0).select("POP").distinct().orderBy("POP").collect()]
    wide = fr.pivoted(_afs(s, d, True), names, "called")
    totals = reduce(lambda a, b: a + b, [F.coalesce(F.col(n), F.lit(0)) for n in names])
    return wide.select("row_idx", F.col("id").alias("variant_id"), F.col(names[0]).alias("first_pop"), F.col(names[-1]).alias("last_pop"), totals.alias("all_pops"))


@query
def afs_maxmiss_poly(s, d):
    return fr.fully_called(_afs(s, d, True)).select("chrom", "pos", "poly")


@query
def afs_samples_per_pop(s, d):
    return fr.samples_per_population(fx.samples(s, d, 0))


def _others(s, d) -> list[DataFrame]:
    return [fx.variants_b(s, d), fx.variants_c(s, d), fx.variants_d(s, d), fx.variants_e(s, d), fx.variants_a(s, d).where(F.lit(False))]


@query
def preflight_intersection(s, d):
    a = fx.variants_a(s, d)
    parts = [pf.intersection(a, o, key).select(F.lit(i).alias("input_idx"), F.lit(key).alias("key"), "n_canonical", "n_other", "n_inter", "frac") for i, o in enumerate(_others(s, d), 1) for key in ("chr_pos", "id")]
    return reduce(DataFrame.unionByName, parts)


@query
def preflight_per_chrom(s, d):
    a = fx.variants_a(s, d)
    return reduce(DataFrame.unionByName, [pf.per_chromosome(a, o, "chr_pos").select(F.lit(i).alias("input_idx"), "chrom", "canonical_size", "other_size", "intersection") for i, o in enumerate(_others(s, d), 1)])


@query
def preflight_per_chrom_id(s, d):
    a = fx.variants_a(s, d)
    return reduce(DataFrame.unionByName, [pf.per_chromosome(a, o, "id").select(F.lit(i).alias("input_idx"), "chrom", "canonical_size", "other_size", "intersection") for i, o in enumerate(_others(s, d), 1)])


@query
def preflight_shift_signature(s, d):
    a, parts = fx.variants_a(s, d), []
    for i, o in enumerate(_others(s, d), 1):
        parts.append(pf.shift_signature(a, o, pf.per_chromosome(a, o, "chr_pos")).select(F.lit(i).alias("input_idx"), "chrom", "median_shift", F.round("rel_mad", 9).alias("rel_mad"), "consistent"))
    return reduce(DataFrame.unionByName, parts)


def _labels(s, d, *keys: str) -> list[tuple[int, str, str]]:
    found = pf.overlaps(fx.variants_a(s, d), _others(s, d))
    return [(c.input_index, key, c.label) for key in keys for c in pf.compared(found, key)]


@query
def preflight_classification(s, d):
    return s.createDataFrame(_labels(s, d, "chr_pos", "id"), "input_idx int, variant_key string, label string")


@query
def preflight_gate(s, d):
    labels = s.createDataFrame(_labels(s, d, "chr_pos"), "input_idx int, variant_key string, label string")
    good = labels.where("input_idx in (1, 3)")
    parts = [ga.preflight_gate(x, p).withColumn("pairs", F.lit(n)) for n, x in (("all", labels), ("good", good)) for p in ("off", "warn", "strict")]
    return reduce(DataFrame.unionByName, parts)


@query
def inspect_counts(s, d):
    return ins.counts(fx.variants_raw(s, d), fx.variants_a(s, d), fx.samples(s, d, 0))


@query
def inspect_populations(s, d):
    return ins.populations(fx.samples(s, d, 0))


@query
def inspect_sex(s, d):
    return ins.sexes(fx.samples(s, d, 0))


@query
def inspect_chrom_counts(s, d):
    return ins.chromosomes(fx.variants_a(s, d))


@query
def inspect_missingness(s, d):
    return ins.missingness(fx.packed(s, d, 2))


@query
def inspect_missingness_hist(s, d):
    return ins.missingness_histogram(ins.missingness(fx.packed(s, d, 2)))


@query
def variant_set_sha256(s, d):
    return fi.fingerprint(fx.variants_raw(s, d), fx.variants_a(s, d))


@query
def duplicate_keys(s, d):
    return al.duplicate_keys(fx.variants_a(s, d), ["id"])


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: SQL[k] for k in _QUERIES if k in SQL}
