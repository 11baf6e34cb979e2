"""Small panel files for tests."""

from __future__ import annotations

import numpy as np

from genoloom.sources.genotypes import encode_pgen, pgen_header


def write_variants(prefix, rows, header="#CHROM\tPOS\tID\tREF\tALT"):
    """rows: (chrom, pos, id, ref, alt)."""
    with open(f"{prefix}.pvar", "w") as f:
        f.write("##fileformat=VCFv4.2\n" + header + "\n")
        f.writelines("\t".join(map(str, r)) + "\n" for r in rows)


def write_pfile(prefix, rows, iids, g, pops=None, extra=None):
    write_variants(prefix, rows)
    pops = pops or ["P0"] * len(iids)
    with open(f"{prefix}.psam", "w") as f:
        f.write("#IID\tSEX\tPOP" + (f"\t{extra[0]}" if extra else "") + "\n")
        for k, (iid, pop) in enumerate(zip(iids, pops, strict=True)):
            f.write(f"{iid}\t{1 + k % 2}\t{pop}" + (f"\t{extra[1]}" if extra else "") + "\n")
    g = np.array(g, dtype=np.int8).reshape(len(rows), len(iids))
    with open(f"{prefix}.pgen", "wb") as f:
        f.write(pgen_header(*g.shape) + encode_pgen(g))
    return prefix


def panel(prefix, n, samples, seed=0, pops=3, start=0):
    """A panel of n A/G variants on chromosomes 1 and 2 with random dosages."""
    rng = np.random.default_rng(seed)
    rows = [(1 + k % 2, 1000 + 10 * k, f"v{k}", "A", "G") for k in range(start, start + n)]
    g = rng.choice([0, 1, 2, -9], size=(n, samples), p=[0.4, 0.3, 0.25, 0.05])
    iids = [f"{prefix.rsplit('/', 1)[-1]}{k}" for k in range(samples)]
    return write_pfile(prefix, rows, iids, g, [f"pop{k % pops}" for k in range(samples)]), rows, iids, g
