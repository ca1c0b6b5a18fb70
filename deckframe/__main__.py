"""Verbs over files: ``python -m deckframe VERB INPUT... [--out FOLDER] [--format json|parquet]``.

Decks and slides are JSON files or folders of them, records JSON lines. A verb's rows
are written to the folder or, without one, shown as JSON lines.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckframe import sources
from deckframe.operators import audits, corpus, exams, inject, judging, layout, manifests, records, simulate, studies
from deckframe.operators import text as wording
from deckframe.sources.flat import tables

Verb = Callable[[SparkSession, argparse.Namespace], DataFrame]
VERBS: dict[str, Verb] = {}


def verb(name: str) -> Callable[[Verb], Verb]:
    def register(f: Verb) -> Verb:
        VERBS[name] = f
        return f

    return register


def _decks(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    return tables(sources.decks(spark, a.input[0]))


def _palette(a: argparse.Namespace) -> tuple:
    return tuple(tuple(int(p[i : i + 2], 16) for i in (0, 2, 4)) for p in a.palette)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file with their places; lines without a word are left out."""
    return spark.read.text(path).where(F.col("value").rlike(r"\S")).select(F.monotonically_increasing_id().alias("ord"), F.col("value").alias("record"))


def _facts(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return records.classified(_lines(spark, a.input[0]))


@verb("lint")
def _lint(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Findings of all detectors, with the element's id."""
    _, elements = _decks(spark, a)
    return layout.lint(elements, _palette(a)).join(elements.select("slide_id", "pos", "element_id"), ["slide_id", "pos"])


@verb("lint-deck")
def _lint_deck(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Terms that a deck spells in two ways."""
    slides, elements = _decks(spark, a)
    texts = elements.join(slides.select("slide_id", "slide_index"), "slide_id").select(F.col("deck_id").alias("deck"), F.col("slide_index").cast("int").alias("slide"), "text")
    glossary = spark.createDataFrame([(t,) for t in a.glossary], "term string") if a.glossary else None
    return wording.variants(wording.occurrences(texts), glossary)


@verb("score")
def _score(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return layout.lint_scores(_decks(spark, a)[1], palette=_palette(a))


@verb("repair")
def _repair(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return inject.repaired(_decks(spark, a)[1])


@verb("snap")
def _snap(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return simulate.snap_to_master(_decks(spark, a)[1])


@verb("hacking-audit")
def _hacking(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    slides, elements = _decks(spark, a)
    return layout.cheats(elements, slides)


@verb("inject")
def _inject(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """What each injector would change: the labels of every slide, at their default or given severity."""
    cells = [(k, a.severity if a.severity is not None else s) for k, s in inject.DEFAULTS.items() if not a.type or k in a.type]
    return inject.slide_labels(_decks(spark, a)[1], cells)


@verb("build-synthetic")
def _synthetic(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    slides, elements = _decks(spark, a)
    return inject.synthetic_manifest(slides, elements, a.repetitions)


@verb("ingest")
def _ingest(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Shapes of PPTX files, elements of annotated HTML, or elements of JSON decks, by the suffix."""
    if a.input[0].lower().endswith(".pptx"):
        return sources.pptx_shapes(spark.read.format("binaryFile").load(a.input[0]))
    if a.input[0].lower().endswith(".html"):
        return sources.html_elements(spark.read.text(a.input[0], wholetext=True).withColumnRenamed("value", "html"))
    return _decks(spark, a)[1]


@verb("generate")
def _generate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Decks laid out from their content."""
    return studies.laid_out(spark.read.text(a.input[0], wholetext=True).withColumnRenamed("value", "content"))


@verb("analyze")
def _analyze(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return judging.aggregate_metrics(_facts(spark, a))


VERBS |= {
    "classify": lambda s, a: _facts(s, a),
    "summary": lambda s, a: records.summary(_facts(s, a)),
    "attribution": lambda s, a: judging.attribute_failures(_facts(s, a)),
    "gaps": lambda s, a: judging.modality_gaps(_facts(s, a)),
    "collapse": lambda s, a: judging.template_collapse(_facts(s, a)),
    "gates": lambda s, a: judging.variance_gates(_facts(s, a)),
    "thresholds": lambda s, a: judging.psychometric(_facts(s, a)),
    "distribution": lambda s, a: judging.distribution(_facts(s, a)),
    "hypotheses": lambda s, a: judging.hypotheses(judging.modality_gaps(_facts(s, a)), judging.template_collapse(_facts(s, a))),
    "panel": lambda s, a: audits.panel_summary(s.read.schema("sample_id string, judge string, score double, source string, ord long").json(a.input[0])),
    "agreement": lambda s, a: audits.agreement(s.read.schema("sample_id string, judge string, score double, source string, ord long").json(a.input[0])),
    "power": lambda s, a: s.createDataFrame([(float(a.input[0]), float(a.input[1]), corpus.sample_size(float(a.input[0]), float(a.input[1])))], "base double, target double, samples int"),
    "matrix": lambda s, a: simulate.matrix(s, *[x.split(",") for x in a.input]),
    "run-matrix": lambda s, a: corpus.probe_grid(_lines(s, a.input[0]), s.read.json(a.input[1])),
    "prepare-benchmark": lambda s, a: records.benchmark_tasks(_lines(s, a.input[0]), a.source),
    "convert-arrow": lambda s, a: manifests.task_rows(sources.arrow_rows(s, a.input[0], "index long, hash string, category string, json_data string, json_content string, image_path string")),
    "prepare-clean-corpus": lambda s, a: _clean(s, a),
    "gepa-plan": lambda s, a: manifests.condition_plan(s, a.input, range(3), 24),
    "build-sft": lambda s, a: exams.results(_labelled(s, a)),
    "list": lambda s, a: sources.listed(sources.corpus_files(s, a.input[0])),
}


def _labelled(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    schema = "sample_id string, labels array<struct<type:string,severity:double,target_element_ids:array<string>,metadata:map<string,string>>>"
    df = spark.read.schema(schema).json(a.input[0]).select("sample_id", F.explode("labels").alias("l"))
    return df.select("sample_id", "l.type", "l.severity", F.coalesce("l.target_element_ids", F.array().cast("array<string>")).alias("targets"), F.coalesce("l.metadata", F.create_map().cast("map<string,string>")).alias("meta"))


def _clean(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    slides, elements = _decks(spark, a)
    decks = slides.select("deck_id").distinct()
    reasons = corpus.reject_reasons(decks, slides, elements)
    accepted = reasons.where("reason is null").select(F.xxhash64("deck_id").alias("ord"), "deck_id", F.lit(a.input[0]).alias("path"))
    return manifests.clean_manifest(accepted, slides, a.source)


def _query(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A registered query over a folder of tables: ``query NAME FOLDER``."""
    from deckframe.queries import QUERIES

    return QUERIES[a.input[0]](spark, a.input[1])


VERBS["query"] = _query


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="deckframe", description=__doc__)
    parser.add_argument("verb", choices=sorted(VERBS))
    parser.add_argument("input", nargs="+")
    parser.add_argument("--out")
    parser.add_argument("--format", default="json", choices=("json", "parquet"))
    parser.add_argument("--palette", nargs="*", default=[], metavar="RRGGBB")
    parser.add_argument("--glossary", nargs="*", default=[])
    parser.add_argument("--type", nargs="*", default=[])
    parser.add_argument("--severity", type=float)
    parser.add_argument("--repetitions", type=int, default=1)
    parser.add_argument("--source", default="local")
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("deckframe").getOrCreate()
    df = VERBS[a.verb](spark, a)
    if a.out:
        df.write.format(a.format).mode("errorifexists").save(a.out)
    else:
        for line in df.toJSON().toLocalIterator() if hasattr(df, "toJSON") else ():
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
