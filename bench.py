"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores.  ``bind_genotypes_per_s``
is cells of both panels by the seconds of the whole bind with the panels derived on
the way (``bind_wide``).  ``bind_written_genotypes_per_s`` is the same for panels
does not count; its seconds are not in the total.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from genoloom import catalogue
from genoloom import fixtures as fx
from genoloom.model import Policy
from genoloom.operators import alignment as al
from genoloom.operators import binding as bi
from genoloom.operators import identity as id_
from genoloom.session import local_session

HEADLINE = ("align_action_histogram", "align_action_histogram_per_chrom", "align_kept_variants", "report_rows", "iid_suffix_simple", "bind_sample_counters", "afs_diploid", "afs_pseudohap_adjusted", "preflight_classification", "inspect_missingness_hist", "variant_set_sha256")


def timed(f) -> float:
    began = time.time()
    f().write.format("noop").mode("overwrite").save()
    return round(time.time() - began, 3)


def written(panels, folder):
    """The panels, read from tables in the folder."""
    out = []
    for i, panel in enumerate(panels):
        tables = {}
        for name in ("variants", "samples", "dosages"):
            path = f"file://{folder}/{i}-{name}"
            getattr(panel, name).write.parquet(path)
            tables[name] = panel.variants.sparkSession.read.parquet(path)
        out.append(panel.with_(**tables))
    return out


def bind(panels):
    """The bind of panels, dosages and all."""
    alignment = al.align(panels[0].variants, [panels[1].variants], Policy())
    plan = id_.identity_plan(panels, Policy(on_collision="suffix"))
    return bi.bind(panels, alignment, al.kept(alignment), plan)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus), memory="8g")
    every = catalogue.queries()
    timed(lambda: every["align_action_histogram"](spark, sf_dir))  # the first query also starts everything
    seconds = {name: timed(lambda name=name: every[name](spark, sf_dir)) for name in HEADLINE}
    seconds["bind_wide"] = timed(lambda: bind(fx.panels(spark, sf_dir)[:2]))
    with tempfile.TemporaryDirectory(prefix="genoloom-bench-") as folder:
        panels = written(fx.panels(spark, sf_dir)[:2], folder)
        seconds["bind_written"] = timed(lambda: bind(panels))
    cells = fx.variants_a(spark, sf_dir).count() * sum(p.samples.count() for p in fx.panels(spark, sf_dir)[:2])
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(v for k, v in seconds.items() if k != "bind_written"), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": int(cpus),
        "bind_genotypes_per_s": round(cells / seconds["bind_wide"]),
        "bind_written_genotypes_per_s": round(cells / seconds["bind_written"]),
    }))


if __name__ == "__main__":
    main()
