"""Raw records as JSON: judged probes, examiner output, manifests and benchmark tasks, to typed rows.

What a record may carry in several places is taken from the first place that has it;
a field that is there and empty counts as there. Numbers that may be words are read
as text first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckframe.functions import texts
from deckframe.operators.contract import RANKS, modality

_LABEL = "struct<type:string,severity:double,target_element_ids:array<string>>"
_DEFECT = "struct<type:string,present:boolean,element_ids:array<string>,target_element_ids:array<string>,severity:string,confidence:double,evidence:string,fix:string>"
_FINDING = "struct<type:string,severity:string,locator:struct<element_id:string,related_page_ids:array<string>>,evidence:string,fix_suggestion:string>"
OUTPUT = f"struct<defects:array<{_DEFECT}>,findings:array<{_FINDING}>,overall_score:double,pairwise_winner:string,better:string>"
_META = "struct<severity_grid_value:double,template_condition:string,resolution:int>"
RECORD = (
    f"struct<sample_id:string,model:string,adapter:string,modality:string,task:string,severity:double,severity_grid_value:double,template_condition:string,resolution:int,"
    f"repair_passed:boolean,labels:array<{_LABEL}>,label_types:array<string>,output:{OUTPUT},parsed:{OUTPUT},metadata:{_META},"
    f"payload:struct<sample_id:string,model:string,modality:string,task:string,expected_labels:array<{_LABEL}>,metadata:{_META}>>"
)
#: What ground truth stands under, in elements and in slides and decks.
HIDDEN_IN_ELEMENTS = ("expected_bbox", "placeholder_bbox", "expected_font_size_pt", "expected_color", "expected_topic", "max_words", "diagram_claim", "diagram_false_claim", "diagram_trend")
HIDDEN_IN_CONTAINERS = ("narrative_order_broken", "required_sections", "swapped_indices", "missing_section", "expected_topic", "canonical_term", "variant_term")


def normalized(output: Column) -> Column:
    """Examiner output of either form as one: defects (type, present, element_ids, severity, severity_level, confidence, evidence, fix), overall_score, pairwise_winner.

    Findings have a level, moderate unless given; a defect's severity is a number or a
    level. Without a score, findings take a fifth off for each rank, and defects give 0.
    """
    ranks = F.create_map(*[F.lit(v) for k, r in RANKS.items() for v in (k, float(r))])
    known = lambda level: level.isin(*RANKS)
    none = F.array().cast("array<string>")

    def of_finding(f: Column) -> Column:
        level = F.coalesce(f["severity"], F.lit("moderate"))
        ids = F.concat(F.when(F.length(f["locator"]["element_id"]) > 0, F.array(f["locator"]["element_id"])).otherwise(none), F.coalesce(f["locator"]["related_page_ids"], none))
        return _defect(F.coalesce(f["type"], F.lit("UNKNOWN")), F.lit(True), ids, ranks[level], level, F.lit(1.0), f["evidence"], f["fix_suggestion"])

    def of_defect(d: Column) -> Column:
        level = F.when(known(d["severity"]), d["severity"])
        number = F.coalesce(F.when(known(d["severity"]), ranks[d["severity"]]), d["severity"].try_cast("double"), F.lit(0.0))
        return _defect(F.coalesce(d["type"], F.lit("UNKNOWN")), F.coalesce(d["present"], F.lit(True)), F.coalesce(d["element_ids"], d["target_element_ids"], none), number, level, F.coalesce(d["confidence"], F.lit(1.0)), d["evidence"], d["fix"])

    contract = output["findings"].isNotNull()
    empty = F.array().cast("array<struct<type:string,present:boolean,element_ids:array<string>,severity:double,severity_level:string,confidence:double,evidence:string,fix:string>>")
    defects = F.when(contract, F.transform(output["findings"], of_finding)).otherwise(F.coalesce(F.transform(output["defects"], of_defect), empty))
    sum_ranks = F.aggregate(F.transform(output["findings"], lambda f: ranks[F.coalesce(f["severity"], F.lit("moderate"))]), F.lit(0.0), lambda a, x: a + x)
    rest = F.when(F.coalesce(F.size(output["defects"]), F.lit(0)) > 0, 0.0).otherwise(1.0)
    score = F.when(contract, F.greatest(F.lit(0.0), 1 - 0.2 * sum_ranks)).otherwise(F.coalesce(output["overall_score"], rest))
    winner = F.when(contract, output["better"]).otherwise(output["pairwise_winner"])
    return F.when(output.isNotNull(), F.struct(defects.alias("defects"), score.alias("overall_score"), winner.alias("pairwise_winner")))


def _defect(kind: Column, present: Column, ids: Column, severity: Column, level: Column, confidence: Column, evidence: Column, fix: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(kind.alias("type"), present.alias("present"), ids.alias("element_ids"), severity.alias("severity"), level.alias("severity_level"), confidence.alias("confidence"), blank(evidence).alias("evidence"), blank(fix).alias("fix"))


def parsed(records: DataFrame, record: str = "record", schema: str = RECORD) -> DataFrame:
    """``records`` with the JSON of ``record`` as a struct r; a record that does not parse has nulls throughout."""
    return records.withColumn("r", F.from_json(record, schema))


def classified(records: DataFrame) -> DataFrame:
    """Of records (ord, record): typed facts as ``judging`` takes them, with the sets of types."""
    df = parsed(records)
    r, payload, meta = F.col("r"), F.col("r.payload"), F.col("r.metadata")
    lifted = F.transform(r["label_types"], lambda t: F.struct(t.alias("type"), F.lit(None).cast("double").alias("severity"), F.lit(None).cast("array<string>").alias("target_element_ids")))
    labels = F.coalesce(r["labels"], payload["expected_labels"], lifted, F.array().cast(f"array<{_LABEL}>"))
    df = df.withColumn("labels", labels).withColumn("out", normalized(F.coalesce(r["output"], r["parsed"])))
    expected = F.transform(F.filter("labels", lambda x: x["type"].isNotNull() & (x["type"] != "") & (x["type"] != "NO_DEFECT")), lambda x: x["type"])
    predicted = F.coalesce(F.transform(F.filter(F.col("out.defects"), lambda d: d["present"] & (d["type"] != "UNKNOWN")), lambda d: d["type"]), F.array().cast("array<string>"))
    severity = F.coalesce(r["severity"], F.get(F.filter("labels", lambda x: x["severity"].isNotNull()), F.lit(0))["severity"])
    along = lambda name: F.coalesce(r[name], meta[name], payload["metadata"][name])
    df = df.select(
        "ord",
        F.coalesce(r["sample_id"], payload["sample_id"], F.lit("")).alias("sample_id"),
        F.coalesce(r["model"], r["adapter"], payload["model"]).alias("model"),
        modality(F.coalesce(r["modality"], payload["modality"], F.lit(""))).alias("modality"),
        F.coalesce(r["task"], payload["task"], F.lit("")).alias("task"),
        expected.alias("expected_types"),
        predicted.alias("predicted_types"),
        severity.alias("severity"),
        F.coalesce(along("severity_grid_value"), severity).alias("grid"),
        along("template_condition").alias("template"),
        along("resolution").alias("resolution"),
        r["repair_passed"].alias("repaired"),
        F.col("out.overall_score").alias("score"),
    )
    right = F.when(F.size("expected_types") == 0, F.size("predicted_types") == 0).otherwise(F.size(F.array_except("expected_types", "predicted_types")) == 0)
    return df.withColumn("correct", right).withColumn("expected", F.get("expected_types", F.lit(0)))


def summary(facts: DataFrame) -> DataFrame:
    """All counts of a run in one row: records, clean ones, models, accuracy, predicted types, and those never expected."""
    wrong = F.size(F.array_except("predicted_types", "expected_types"))
    return facts.agg(
        F.count("*").alias("records"),
        F.count_if(F.size("expected_types") == 0).alias("clean"),
        F.countDistinct("model").alias("models"),
        F.countDistinct("sample_id").alias("samples"),
        F.count_if("correct").alias("correct"),
        F.sum(F.size("predicted_types")).alias("predicted"),
        F.sum(wrong).alias("wrong_types"),
        F.count("repaired").alias("repairs"),
        F.round(F.avg("score"), 6).alias("mean_score"),
    )


_KEYS = "map<string,string>"
ELEMENT = f"struct<element_id:string,type:string,text:string,metadata:{_KEYS}>"
SLIDE = f"struct<slide_id:string,metadata:{_KEYS},elements:array<{ELEMENT}>>"
DECK = f"struct<deck_id:string,metadata:{_KEYS},slides:array<{SLIDE}>>"


def model_view(artifact: Column, kind: str = "deck") -> Column:
    """A slide or deck without the keys under which ground truth stands."""
    without = lambda m, keys: F.map_filter(m, lambda k, v: ~k.isin(*keys))
    element = lambda e: F.struct(e["element_id"].alias("element_id"), e["type"].alias("type"), e["text"].alias("text"), without(e["metadata"], HIDDEN_IN_ELEMENTS).alias("metadata"))
    slide = lambda s: F.struct(s["slide_id"].alias("slide_id"), without(s["metadata"], HIDDEN_IN_CONTAINERS).alias("metadata"), F.transform(s["elements"], element).alias("elements"))
    if kind == "slide":
        return slide(artifact)
    return F.struct(artifact["deck_id"].alias("deck_id"), without(artifact["metadata"], HIDDEN_IN_CONTAINERS).alias("metadata"), F.transform(artifact["slides"], slide).alias("slides"))


#: What a manifest's row may name its target by.
def target_type(defect_type: Column, defect: Column, oracle_type: Column, oracle_defect: Column, labels: Column) -> Column:
    """The defect that a sample is about: of its own fields, of its oracle, else of its first label."""
    return F.coalesce(defect_type, defect, oracle_type, oracle_defect, F.get(labels, F.lit(0)))


# --- benchmark tasks --------------------------------------------------------------------------------------------------

TASK_KEYS = ("task_subset", "subset", "task_type", "task")
PATH_KEYS = ("pptx_path", "deck_path", "slide_path", "artifact_path", "source_artifact_path")
BLOCKED = ("deck", "slide", "slides", *PATH_KEYS, "metadata")


def first_of(record: Column, keys: tuple[str, ...]) -> Column:
    """The first of some keys of a JSON object that has a value, as text."""
    return F.coalesce(*[F.nullif(F.get_json_object(record, f"$.{k}"), F.lit("")) for k in keys])


def benchmark_tasks(records: DataFrame, source: str, subset: str | None = None, record: str = "record") -> DataFrame:
    """Of task records (ord, record): sample_id, task_subset, task (the record without artifacts, as JSON), what artifact it carries or asks for."""
    r = F.col(record)
    index = F.col("ord").cast("string")
    name = F.coalesce(first_of(r, ("sample_id", "id")), F.concat(F.lit(f"{source.lower()}_"), F.lpad(index, F.greatest(F.lit(6), F.length(index)), F.lit("0"))))
    has = lambda key: F.get_json_object(r, f"$.{key}").isNotNull()
    carried = F.when(has("deck"), "deck").when(has("slide"), "slide").when(has("slides"), "slides")
    rest = F.map_filter(F.from_json(r, _KEYS), lambda k, v: ~k.isin(*BLOCKED))
    path = first_of(r, PATH_KEYS)
    return records.select(
        "ord",
        name.alias("sample_id"),
        F.lit(source.lower()).alias("source_name"),
        F.coalesce(first_of(r, TASK_KEYS), F.lit(subset or "unknown")).alias("task_subset"),
        F.array_sort(F.map_keys(rest)).alias("task_keys"),
        carried.alias("artifact"),
        F.when(carried.isNotNull(), F.concat(texts.safe_id(name), F.lit("_deck.json"))).alias("deck_ir_path"),
        F.when(carried.isNull(), path).alias("source_artifact_path"),
        (carried.isNull() & path.isNotNull()).alias("requires_artifact"),
    )


def task_summary(tasks: DataFrame) -> DataFrame:
    """By subset: records, those with an artifact of their own, and those that ask for one."""
    return tasks.groupBy("task_subset").agg(F.count("*").alias("records"), F.count("artifact").alias("converted_ir"), F.count_if("requires_artifact").alias("missing_artifacts"))


def annotated_manifest(annotations: DataFrame, kinds: DataFrame) -> DataFrame:
    """Of answers (sample_id, deficiency, strong, response) and kinds (deficiency, type): labels present and types confidently absent, by sample.

    Only answers with strong agreement count; every sample has a row.
    """
    told = annotations.join(F.broadcast(kinds), "deficiency", "left")
    sure = F.col("type").isNotNull() & F.col("strong")
    pick = lambda ok: F.array_sort(F.collect_set(F.when(sure & ok, F.col("type"))))
    return told.groupBy("sample_id").agg(pick(F.col("response")).alias("labels"), pick(~F.col("response")).alias("confident_absent"))


def registry(defaults: DataFrame, overlay: DataFrame, key: str = "name") -> DataFrame:
    """Default entries, each with what the overlay says of it instead, and the overlay's own."""
    columns = [c for c in defaults.columns if c != key]
    d, o = defaults.alias("d"), overlay.alias("o")
    joined = d.join(o, F.col(f"d.{key}") == F.col(f"o.{key}"), "full")
    return joined.select(F.coalesce(f"d.{key}", f"o.{key}").alias(key), *[F.coalesce(f"o.{c}", f"d.{c}").alias(c) for c in columns])
