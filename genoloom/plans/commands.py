"""The five commands: merge, validate, afs, hash and inspect.

Each is a sequence of lazy tables and a few actions: metadata first, gates on
small aggregates, and only then the dosages.
"""

from __future__ import annotations

import os
import sys
import time
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ALL_CHROMOSOMES, AUTOSOMES, HISTOGRAM_KEYS, InvariantBroken, Panel, PanelError, Policy, ValidationFailed
from ..operators import alignment as al
from ..operators import binding as bi
from ..operators import fingerprint as fi
from ..operators import frequencies as fr
from ..operators import gates as ga
from ..operators import identity as id_
from ..operators import inspection as ins
from ..operators import preflight as pf
from ..sources import sinks
from ..sources.detect import strip_known_suffix
from ..sources.panels import read_panel
from ..sources.text import relabel_pairs

VERSION = "0.1.0"


def _load(spark: SparkSession, inputs: list[str], targets: list[str]) -> list[Panel]:
    panels = [read_panel(spark, p) for p in inputs] + [read_panel(spark, p, is_target=True) for p in targets]
    return [p.with_(variants=p.variants.persist()) for p in panels]


def _release(panels: list[Panel]) -> None:
    for p in panels:
        p.variants.unpersist()


def _prepare_samples(spark: SparkSession, panels: list[Panel], policy: Policy, relabel: tuple[str, str | None, str | None] | None, required: bool = True, detect: bool = True) -> list[Panel]:
    """Samples with POP and FID; without detection there is a POP only where a relabel table with its own columns gives one."""
    out = []
    for panel in panels:
        if detect:
            panel = id_.with_population(panel, policy.population_column, required)
        elif relabel is not None:
            panel = panel.with_(samples=panel.samples.drop("POP").withColumn("POP", F.col(policy.id_column)))
        if "POP" in panel.samples.columns:
            if relabel is not None:
                pairs = relabel_pairs(spark, *relabel)
                panel = panel.with_(samples=id_.relabel(panel.samples, pairs, "POP" if relabel[1] is None else policy.id_column))
            panel = panel.with_(samples=id_.family_from_population(panel.samples))
        out.append(panel)
    return out


def _preflight(panels: list[Panel], policy: Policy, command: str, json_path: str | None, quiet: bool, err: TextIO | None) -> dict[str, Any]:
    """Compares, writes the document before anything acts on it, then warns or raises."""
    compared = pf.compared(pf.overlaps(panels[0].variants, [p.variants for p in panels[1:]]), policy.variant_key, [p.path for p in panels[1:]])
    document = pf.report([p.path for p in panels], compared, policy, command, VERSION)
    if json_path:
        sinks.write_json(document, json_path)
    gate = document["gate"]
    said = "; ".join(f"panel {c.input_index} ({c.path}): {c.label}" for c in compared if c.label != "compatible")
    if gate["action"] == "warn" and not quiet:
        print(f"warning: {said}", file=err or sys.stderr)
    if gate["action"] == "error":
        raise ValidationFailed(f"preflight: {said}")
    return document


def _check_others(panels: list[Panel], policy: Policy) -> None:
    al.require_unique(panels[0].variants, policy.keys, "the first panel")
    for i, panel in enumerate(panels[1:], 1):
        al.require_unique(panel.variants, policy.keys, f"panel {i}")


def _align(panels: list[Panel], policy: Policy) -> tuple[DataFrame, int]:
    """(alignment, extras), with unique keys on every side."""
    _check_others(panels, policy)
    others = [p.variants for p in panels[1:]]
    alignment = al.align(panels[0].variants, others, policy).persist()
    extra = al.extras(panels[0].variants, others, policy).agg(F.coalesce(F.sum("extras"), F.lit(0)).alias("x")).first().x
    return alignment, int(extra)


def _raise_policies(alignment: DataFrame, extra: int, policy: Policy) -> None:
    """The first policy that is ``error`` and has a case: missing, mismatch, strand, extra."""
    counts = al.policy_triggers(alignment, extra, policy)
    for name in ("on_missing", "on_mismatch", "on_strand", "on_extra"):
        if counts[name]:
            raise InvariantBroken(f"{name}=error: {counts[name]:,} variants")


def _gates(panels: list[Panel], alignment: DataFrame, extra: int, n_canonical: int, policy: Policy) -> None:
    if not n_canonical:
        return
    if policy.on_extra == "warn" and extra > policy.extras_warn_threshold * n_canonical:
        raise ValidationFailed(f"the other panels have {extra:,} variants that the first lacks, more than {policy.extras_warn_threshold:.0%} of its {n_canonical:,}")
    gate = ga.ambiguous_gate(alignment, policy).first()
    if gate.fires:
        raise ValidationFailed(f"{gate.numerator:,} strand-ambiguous drops among {gate.denominator:,} shared variants are more than {policy.validate_strand_fail_pct:g} %")


def _counts(alignment: DataFrame) -> dict[str, Any]:
    total = al.histogram(alignment).first().asDict()
    by = {str(r.chrom): {k: r[k] for k in HISTOGRAM_KEYS} for r in al.histogram_by_chromosome(alignment).orderBy("chrom").collect()}
    return {"action_histogram": total, "action_histogram_per_chrom": by, "intersection_size": al.intersection_size(alignment).first().n}


def _alignment_lines(hist: dict[str, int]) -> list[str]:
    dropped = sum(hist[k] for k in HISTOGRAM_KEYS[4:])
    lines = [f"  {'Passthrough:':<18} {hist['passthrough']:>12,}", f"  {'REF/ALT swapped:':<18} {hist['swap']:>12,}", f"  {'Strand-flipped:':<18} {hist['flip']:>12,}", f"  {'Filled missing:':<18} {hist['fill_missing']:>12,}", f"  {'Dropped:':<18} {dropped:>12,}"]
    names = {"dropped_ambiguous_strand": "Ambiguous strand", "dropped_allele_mismatch": "Allele mismatch", "dropped_on_strand": "Strand policy", "drop": "Missing policy"}
    return lines + [f"    {names[k] + ':':<20} {hist[k]:,}" for k in names if hist[k]]


def _populations(panels: list[Panel]) -> list[dict[str, int]]:
    return [{r.pop: r.n for r in ins.populations(p.samples).orderBy("rank").collect()} if "POP" in p.samples.columns else {} for p in panels]


def _report(command: str, panels: list[Panel], policy: Policy, counts: dict[str, Any], extra: int, output: dict[str, Any], mix: dict[str, int], raw: bool) -> dict[str, Any]:
    return {
        "tool": "genoloom",
        "tool_version": VERSION,
        "command": command,
        "inputs": [{"path": p.path, "format": p.format, "n_samples": p.samples.count(), "n_variants": p.n_raw if raw else p.variants.count()} for p in panels],
        "policy": {k: getattr(policy, k) for k in ("on_mismatch", "on_missing", "on_extra", "on_strand", "on_collision", "trust_strand", "variant_key", "validate_strand_fail_pct", "extras_warn_threshold")},
        "alignment": counts | {"extras_count": extra},
        "output": output,
        "pseudohaploid": mix,
        "per_input_populations": _populations(panels),
    }


def _report_variants(alignment: DataFrame) -> list[dict[str, Any]]:
    rows = al.report_rows(alignment).orderBy("input_index", "canonical_row").drop("canonical_row")
    return [r.asDict() | {"reason": r.reason or None} for r in rows.toLocalIterator()]


def merge(
    spark: SparkSession,
    inputs: list[str],
    output: str,
    targets: list[str] | None = None,
    policy: Policy | None = None,
    relabel: tuple[str, str | None, str | None] | None = None,
    report: str | None = None,
    report_json: str | None = None,
    include_rows: bool = False,
    preflight_json: str | None = None,
    parquet: bool = False,
    quiet: bool = False,
    out: TextIO | None = None,
    err: TextIO | None = None,
) -> dict[str, Any]:
    """Binds panels into the files at ``output``; returns the run report."""
    policy, began = policy or Policy(), time.time()
    output = strip_known_suffix(output)
    staged = sinks.Staged()
    triplet = [f"{output}{x}" for x in (".pgen", ".pvar", ".psam")]
    with sinks.output_lock(output):
        panels = _load(spark, inputs, targets or [])
        try:
            panels = _prepare_samples(spark, panels, policy, relabel)
            try:
                _preflight(panels, policy, "merge", preflight_json or f"{output}.preflight.json", quiet, err)
            except ValidationFailed:
                for path in triplet:  # what an earlier run left there must not pass for this one's
                    if os.path.exists(path):
                        os.unlink(path)
                raise
            plan = id_.identity_plan(panels, policy).persist()
            overrides = _overrides(spark, panels, plan)
            alignment, extra = _align(panels, policy)
            _raise_policies(alignment, extra, policy)
            n_canonical = panels[0].variants.count()
            if extra > policy.extras_warn_threshold * n_canonical and policy.on_extra == "warn" and not quiet:
                print(f"warning: {extra:,} variants of other panels are not in the first", file=err or sys.stderr)
            _gates(panels, alignment, extra, n_canonical, policy)
            kept = al.kept(alignment).persist()
            n_kept, n_out = kept.count(), plan.count()
            bound = bi.bind(panels, alignment, kept, plan).persist()
            counters = bi.counters_by_id(bound, plan).persist()
            goals = plan.where(F.col("input_idx").isin([i for i, p in enumerate(panels) if p.is_target])).select(F.col("iid_out").alias("iid"))
            low = ga.call_rate_gate(counters, goals, n_canonical, policy).where("fires").orderBy("numerator", "iid")
            worst = low.head(5)
            if worst:
                raise ValidationFailed(f"target call rate below {policy.target_min_call_rate:g}: " + ", ".join(f"{r.iid} {r.numerator}/{r.denominator}" for r in worst))
            if parquet:
                sinks.write_parquet(bound, staged.path(f"{output}.parquet"))
            else:
                sinks.write_pgen(bound, n_kept, n_out, staged.path(triplet[0]))
            sinks.write_variants(kept, staged.path(triplet[1]))
            status = bi.statuses(counters, overrides)
            samples = id_.sample_union(panels, plan).drop("PSEUDOHAPLOID").join(status.select("out_ord", F.col("iid").alias("_iid"), F.col("status").alias("PSEUDOHAPLOID")), "out_ord")
            if samples.where(F.col("_iid") != F.col("IID")).head(1):
                raise InvariantBroken("sample table and genotypes do not have the same order")
            sinks.write_samples(samples.drop("_iid"), staged.path(triplet[2]))
            if report:
                sinks.write_report(al.report_rows(alignment), staged.path(report))
            mix = {"pseudohaploid": 0, "diploid": 0, "unknown": 0} | {{"1": "pseudohaploid", "0": "diploid", "U": "unknown"}[r.status]: r.n for r in bi.status_mix(bi.statuses(counters)).collect()}
            counts = _counts(alignment)
            document = _report("merge", panels, policy, counts, extra, {"n_samples": n_out, "n_variants": n_kept, "paths": {x[-4:] if x in triplet else "parquet": x for x in ([f"{output}.parquet", *triplet[1:]] if parquet else triplet)}}, mix, raw=True)
            if include_rows:
                if n_kept * (len(panels) - 1) * sinks.ROW_BYTES > sinks.LARGE_REPORT and not quiet:
                    print("warning: the report will be larger than 100 MB", file=err or sys.stderr)
                document["variants"] = _report_variants(alignment)
            if report_json:
                sinks.write_json(document, staged.path(report_json))
            staged.commit()
        except PanelError:
            staged.discard()
            for path in triplet:
                if os.path.exists(path) and not parquet:
                    os.unlink(path)
            raise
        finally:
            staged.discard()
            _release(panels)
            spark.catalog.clearCache()
    if not quiet:
        pops = document["per_input_populations"]
        lines = [f"Read {len(panels)} inputs:"]
        lines += [f"  [{i}] {x['path']}: {x['n_samples']:,} samples" + ("  (canonical)" if not i else "") for i, x in enumerate(document["inputs"])]
        lines += ["", f"Variant alignment (canonical = {panels[0].path}):", *_alignment_lines(counts["action_histogram"]), "", "Per-population sample counts:"]
        lines += [f"  [{i}] {len(p)} populations, {sum(p.values()):,} samples" + (f" (largest: {next(iter(p))} n={next(iter(p.values())):,})" if p else "") for i, p in enumerate(pops)]
        lines += ["", "Pseudohaploid mix (output):", f"  {mix['pseudohaploid']:,} pseudohaploid, {mix['diploid']:,} diploid, {mix['unknown']:,} unknown", "", "Wrote:"]
        lines += [f"  {p} ({sinks.human_bytes(os.path.getsize(p))})" for p in triplet if os.path.exists(p)]
        lines += ["", f"Done: {n_out:,} samples x {n_kept:,} variants in {time.time() - began:.2f}s."]
        print("\n".join(lines), file=out)
    return document


def _overrides(spark: SparkSession, panels: list[Panel], plan: DataFrame) -> DataFrame | None:
    """iid, status of the sidecars, by output ids; an id that its panel lacks is an error."""
    given = [(i, iid, str(flag)) for i, p in enumerate(panels) for iid, flag in p.overrides.items()]
    if not given:
        return None
    rows = spark.createDataFrame(given, "input_idx int, iid_in string, status string")
    orphans = rows.join(id_.identities(panels).withColumnRenamed("iid", "iid_in"), ["input_idx", "iid_in"], "left_anti").orderBy("input_idx", "iid_in").head(5)
    if orphans:
        raise InvariantBroken(f"a sidecar names samples that are not there: {', '.join(r.iid_in for r in orphans)}")
    return rows.join(plan, ["input_idx", "iid_in"]).select(F.col("iid_out").alias("iid"), "status")


def validate(
    spark: SparkSession,
    inputs: list[str],
    policy: Policy | None = None,
    relabel: tuple[str, str | None, str | None] | None = None,
    no_population_column: bool = False,
    report: str | None = None,
    report_json: str | None = None,
    include_rows: bool = False,
    preflight_json: str | None = None,
    quiet: bool = False,
    out: TextIO | None = None,
    err: TextIO | None = None,
) -> dict[str, Any]:
    """Everything of merge that needs no genotypes; policies that raise there are counted here."""
    policy, began = policy or Policy(), time.time()
    panels = _load(spark, inputs, [])
    try:
        panels = _prepare_samples(spark, panels, policy, relabel, required=not no_population_column, detect=not no_population_column)
        preflight = _preflight(panels, policy, "validate", preflight_json, quiet, err)
        alignment, extra = _align(panels, policy)
        n_canonical = panels[0].variants.count()
        if extra > policy.extras_warn_threshold * n_canonical and not quiet:
            print(f"warning: {extra:,} variants of other panels are not in the first", file=err or sys.stderr)
        _gates(panels, alignment, extra, n_canonical, policy)
        triggers = al.policy_triggers(alignment, extra, policy)
        if any(triggers.values()):
            raise ValidationFailed("; ".join(f"{k}=error: {v:,} variants" for k, v in triggers.items() if v))
        id_.identity_plan(panels, policy)
        counts = _counts(alignment)
        n_kept = al.kept(alignment).count()
        if report:
            sinks.write_report(al.report_rows(alignment), report)
        n_samples = sum(p.samples.count() for p in panels)
        document = _report("validate", panels, policy, counts, extra, {"n_samples": n_samples, "n_variants": n_kept, "paths": {}}, {"pseudohaploid": 0, "diploid": 0, "unknown": 0}, raw=False)
        if include_rows:
            document["variants"] = _report_variants(alignment)
        if report_json:
            sinks.write_json(document, report_json)
    finally:
        _release(panels)
        spark.catalog.clearCache()
    if not quiet:
        hist = counts["action_histogram"]
        lines = [f"Read {len(panels)} inputs:"]
        lines += [f"  [{i}] {x['path']}: {x['n_samples']:,} samples, {x['n_variants']:,} variants" + ("  (canonical)" if not i else "") for i, x in enumerate(document["inputs"])]
        lines += ["", f"Preflight (variant_key={policy.variant_key}):"]
        lines += [f"  [{c['input_index']}] intersection={c['intersection']:,} ({c['intersection_fraction_of_min']:.1%} of min)  classification={c['classification']}" for c in preflight["comparisons"]]
        lines += [f"  gate: {preflight['gate']['action']} (policy={preflight['gate']['policy']})", "", "Variant alignment:", *_alignment_lines(hist), ""]
        lines += [f"Validation passed: {counts['intersection_size']:,} intersection, {extra:,} extras. Done in {time.time() - began:.2f}s."]
        print("\n".join(lines), file=out)
    return document


def afs(
    spark: SparkSession,
    input_path: str,
    output_dir: str,
    population_column: str | None = None,
    populations: list[str] | None = None,
    adjust: bool = True,
    include_sex_chrom: bool = False,
    quiet: bool = False,
    out: TextIO | None = None,
) -> dict[str, Any]:
    """Frequencies by population: afs_snp.tsv, afs_freq.tsv, afs_counts.tsv and a manifest."""
    chromosomes = ALL_CHROMOSOMES if include_sex_chrom else AUTOSOMES
    panel = id_.with_population(read_panel(spark, input_path, chromosomes), population_column)
    places = fr.population_places(panel.samples, populations, fr.haploid_flags(panel))
    chosen = panel.variants.where(F.col("chrom").isin(*chromosomes))
    n = chosen.count()
    if not n:
        raise InvariantBroken(f"{input_path} has no variant on the chosen chromosomes")
    freqs = fr.frequencies(chosen, panel.dosages, places, adjust, chromosomes).persist()
    staged = sinks.Staged()
    try:
        names = {k: f"afs_{k}.tsv" for k in ("snp", "freq", "counts")}
        snps = sinks.rendered(chosen.orderBy("row_idx"), ["id", "chrom", "pos", "ref", "alt", "cm"])
        sinks.write_lines(snps, "variant_id\tchrom\tpos\tref\talt\tcm", staged.path(f"{output_dir}/{names['snp']}"))
        for kind, value in (("freq", "freq"), ("counts", "called")):
            wide = fr.pivoted(freqs, places.names, value).orderBy("row_idx")
            sinks.write_lines(sinks.rendered(wide, ["id", *places.names], "%.7g"), "\t".join(["variant_id", *places.names]), staged.path(f"{output_dir}/{names[kind]}"))
        manifest = {
            "tool": "genoloom",
            "tool_version": VERSION,
            "command": "afs",
            "input": input_path,
            "n_variants": n,
            "n_populations": len(places.names),
            "populations": places.names,
            "n_samples_per_pop": {k: len(places.places[k]) for k in places.names},
            "adjust_pseudohaploid_requested": adjust,
            "adjust_pseudohaploid_applied": adjust and any(places.haploid),
            "include_chrom": list(chromosomes),
            "files": names,
        }
        sinks.write_json(manifest, staged.path(f"{output_dir}/afs_manifest.json"))
        staged.commit()
    finally:
        staged.discard()
        freqs.unpersist()
    if not quiet:
        print(f"Wrote frequencies of {n:,} variants in {len(places.names)} populations to {output_dir}", file=out)
    return manifest


def hash_variants(spark: SparkSession, input_path: str, emit_canonical: bool = False, out: TextIO | None = None) -> str:
    """Prints ``sha256:<hex>``, or the canonical text itself."""
    variants = read_panel(spark, input_path).variants
    if emit_canonical:
        for piece in fi.canonical_bytes(variants):
            (out or sys.stdout).write(piece.decode())
        return ""
    digest = f"sha256:{fi.variant_set_hash(variants)[0]}"
    print(digest, file=out)
    return digest


def inspect(spark: SparkSession, input_path: str) -> dict[str, Any]:
    """The summary of one panel."""
    panel = id_.with_population(read_panel(spark, input_path, strict=False))
    n_samples = panel.samples.count()
    pops = {r.pop: r.n for r in ins.populations(panel.samples).orderBy("rank").collect()}
    sexes = {r.sex: r.n for r in ins.sexes(panel.samples).collect()} if "SEX" in panel.samples.columns else {}
    histogram = None
    if panel.fault:
        histogram = {"status": "skipped", "reason": panel.fault}
    elif n_samples and panel.n_raw:
        rows = ins.missingness_histogram(ins.missingness(panel.dosages)).orderBy("bin").collect()
        histogram = {"bins": {r.label: r.n for r in rows}, "n_variants_scanned": panel.n_raw}
    return {
        "input_path": input_path,
        "format": panel.format,
        "n_samples": n_samples,
        "n_variants_pre_filter": panel.n_raw,
        "n_variants_post_filter_biallelic_snp": panel.variants.count(),
        "n_populations": len(pops),
        "populations": pops,
        "sex_distribution": sexes,
        "variants_per_chrom": {r.chrom: r.n for r in ins.chromosomes(panel.variants).orderBy("chrom").collect()},
        "missingness_histogram": histogram,
    }


def inspect_text(summary: dict[str, Any]) -> str:
    """The summary between tabs."""
    lines = [f"{k}\t{summary[k]}" for k in ("input_path", "format", "n_samples", "n_variants_pre_filter", "n_variants_post_filter_biallelic_snp", "n_populations")]
    for title in ("populations", "sex_distribution", "variants_per_chrom"):
        if summary[title] or title == "populations":
            items = sorted(summary[title].items()) if title == "sex_distribution" else summary[title].items()
            lines += ["", f"{title}:", *[f"  {k}\t{v}" for k, v in items]]
    found = summary["missingness_histogram"]
    if found is None:
        lines += ["", "missingness_histogram\t(no variants to scan)"]
    elif "bins" not in found:
        lines += ["", f"missingness_histogram\tskipped: {found['reason']}"]
    else:
        lines += ["", f"missingness_histogram (per-sample missing rate over {found['n_variants_scanned']} variants):", *[f"  {k}\t{v}" for k, v in found["bins"].items()]]
    return "\n".join(lines) + "\n"
