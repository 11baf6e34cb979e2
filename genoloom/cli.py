"""Command line: ``python -m genoloom merge | validate | afs | hash | inspect``."""

from __future__ import annotations

import argparse
import json
import sys
import traceback

from .model import PanelError, Policy, UsageFailed


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise UsageFailed(message)


def _alignment_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--variant-key", choices=Policy.CHOICES["variant_key"], default="chr_pos")
    p.add_argument("--on-mismatch", choices=Policy.CHOICES["on_mismatch"], default="drop")
    p.add_argument("--on-missing", choices=Policy.CHOICES["on_missing"], default="fill_missing")
    p.add_argument("--on-extra", choices=Policy.CHOICES["on_extra"], default="warn")
    p.add_argument("--on-strand", choices=Policy.CHOICES["on_strand"], default="flip")
    p.add_argument("--trust-strand", action="store_true")
    p.add_argument("--on-collision", choices=Policy.CHOICES["on_collision"], default="error")
    p.add_argument("--id-column", default="IID")
    p.add_argument("--population-column")
    p.add_argument("--validate-strand-fail-pct", type=float, default=10.0)
    p.add_argument("--relabel-from")
    p.add_argument("--relabel-input-col")
    p.add_argument("--relabel-output-col")
    p.add_argument("--report")
    p.add_argument("--report-json")
    p.add_argument("--preflight-policy", choices=Policy.CHOICES["preflight_policy"], default="warn")
    p.add_argument("--preflight-json")
    p.add_argument("--quiet", action="store_true")


def parser() -> argparse.ArgumentParser:
    top = _Parser(prog="genoloom", description="Bind and summarise genotype panels with Spark.")
    commands = top.add_subparsers(dest="command", required=True, parser_class=_Parser)
    p = commands.add_parser("merge", help="bind panels into one")
    p.add_argument("inputs", nargs="+")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--target", action="append", default=[])
    p.add_argument("--target-min-call-rate", type=float, default=0.40)
    p.add_argument("--report-json-include-rows", action="store_true")
    p.add_argument("--parquet", action="store_true", help="write dosages as Parquet instead of .pgen")
    p.add_argument("--block-size", type=int, default=2048, help="accepted for compatibility; Spark sizes its own blocks")
    _alignment_options(p)
    p = commands.add_parser("validate", help="everything of merge but the genotypes")
    p.add_argument("inputs", nargs="+")
    p.add_argument("--no-population-column", action="store_true")
    p.add_argument("--report-json-include-rows", action="store_true")
    _alignment_options(p)
    p = commands.add_parser("afs", help="allele frequencies by population")
    p.add_argument("input")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--population-column")
    p.add_argument("--populations", action="append")
    p.add_argument("--no-pseudohaploid-adjust", action="store_true")
    p.add_argument("--include-sex-chrom", action="store_true")
    p.add_argument("--block-size", type=int, default=2048, help="accepted for compatibility; Spark sizes its own blocks")
    p.add_argument("--quiet", action="store_true")
    p = commands.add_parser("hash", help="fingerprint of the variants")
    p.add_argument("input")
    p.add_argument("--emit-canonical", action="store_true")
    p = commands.add_parser("inspect", help="summary of a panel")
    p.add_argument("input")
    p.add_argument("--json", action="store_true")
    return top


def _policy(a: argparse.Namespace) -> Policy:
    names = ("variant_key", "on_mismatch", "on_missing", "on_extra", "on_strand", "trust_strand", "on_collision", "id_column", "population_column", "validate_strand_fail_pct", "preflight_policy")
    more = {"target_min_call_rate": a.target_min_call_rate} if a.command == "merge" else {}
    return Policy(**{n: getattr(a, n) for n in names}, **more)


def _relabel(a: argparse.Namespace) -> tuple[str, str | None, str | None] | None:
    if a.relabel_from is None:
        if a.relabel_input_col or a.relabel_output_col:
            raise UsageFailed("relabel columns need --relabel-from")
        return None
    if (a.relabel_input_col is None) != (a.relabel_output_col is None):
        raise UsageFailed("--relabel-input-col and --relabel-output-col go together")
    return a.relabel_from, a.relabel_input_col, a.relabel_output_col


def run(argv: list[str], spark=None) -> int:
    """Runs a command and returns its exit code: 0 done, 1 a gate fired, 2 I/O, 3 data, 4 usage."""
    try:
        a = parser().parse_args(argv)
        if a.command == "merge" and len(a.inputs) + len(a.target) < 2:
            raise UsageFailed("merge needs two panels or more")
        if a.command == "validate" and len(a.inputs) < 2:
            raise UsageFailed("validate needs two panels or more")
        if a.command == "validate" and a.no_population_column and a.population_column:
            raise UsageFailed("--no-population-column contradicts --population-column")
        if a.command == "validate" and a.no_population_column and a.relabel_from and a.relabel_input_col is None:
            raise UsageFailed("--no-population-column with --relabel-from needs --relabel-input-col, as there is no population to look up")
        if a.command in ("merge", "validate") and a.report_json_include_rows and not a.report_json:
            raise UsageFailed("--report-json-include-rows needs --report-json")
        from .plans import commands
        from .session import local_session

        spark = spark or local_session()
        if a.command == "merge":
            commands.merge(spark, a.inputs, a.output, a.target, _policy(a), _relabel(a), a.report, a.report_json, a.report_json_include_rows, a.preflight_json, a.parquet, a.quiet)
        elif a.command == "validate":
            commands.validate(spark, a.inputs, _policy(a), _relabel(a), a.no_population_column, a.report, a.report_json, a.report_json_include_rows, a.preflight_json, a.quiet)
        elif a.command == "afs":
            commands.afs(spark, a.input, a.output, a.population_column, a.populations, not a.no_pseudohaploid_adjust, a.include_sex_chrom, a.quiet)
        elif a.command == "hash":
            commands.hash_variants(spark, a.input, a.emit_canonical)
        else:
            summary = commands.inspect(spark, a.input)
            print(json.dumps(summary, indent=2) if a.json else commands.inspect_text(summary), end="\n" if a.json else "")
        return 0
    except PanelError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code
    except Exception:  # noqa: BLE001 - any other failure has the code of broken data
        traceback.print_exc()
        return 3


def main() -> None:
    sys.exit(run(sys.argv[1:]))
