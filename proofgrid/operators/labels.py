"""Cleaning of model output: JSON recovery, typed coercion, label repair and tags."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofgrid.functions.numeric import clamp
from proofgrid.functions.text import count_matches, let
from proofgrid.operators.ranking import first_by, top_k

# Enums, word lists, patterns and confidences of the label rules.
SCENE_TYPES = ["exterior", "interior", "floor_plan", "non_property", "unknown"]
ROOM_TYPES = ["bedroom", "bathroom", "kitchen", "living_room", "dining_room", "office", "garage", "basement", "attic",
              "corridor", "closet", "stair", "utility", "exterior", "unknown"]
FLOOR_HINTS = ["basement", "ground", "upper", "attic", "unknown"]
RELEVANCES = ["likely", "unlikely", "unknown"]
CONNECTIONS = ["door", "corridor", "stair_up", "stair_down", "window"]
PROSE_SCENES = ["floor_plan", "non_property", "exterior", "interior", "unknown"]
PROSE_ROOMS = ["living_room", "dining_room", "bathroom", "bedroom", "kitchen", "corridor", "basement", "utility",
               "exterior", "garage", "office", "closet", "attic", "stair", "unknown"]
PROSE_RELEVANCES = ["unlikely", "likely", "unknown"]
PROSE_CONNECTIONS = ["stair_down", "stair_up", "corridor", "window", "door"]
INDOOR_ROOMS = ["bedroom", "bathroom", "kitchen", "living_room", "dining_room", "office", "garage", "basement",
                "attic", "corridor", "closet", "stair", "utility"]
LAUNDRY = r"\b(?:washer|dryer|laundry|utility sink)\b"
COOKING = r"\b(?:oven|stove|cooktop|range|kitchen island)\b"
KITCHEN_TERMS = [r"\bstove\b", r"\b(?:oven|cooktop|range)\b", r"\bsink\b", r"\brefrigerator\b", r"\bcabinet",
                 r"\bisland\b"]
BATHROOM_TERMS = [r"\btoilet\b", r"\bsink\b", r"\b(?:shower|tub|bathtub)\b", r"\bvanity\b"]
# room, pattern that must occur, second pattern that must occur too (or None)
ROOM_RULES = [
    ("utility", r"\b(?:laundry|utility room)\b", r"\b(?:washer|dryer)\b"),
    ("bedroom", r"\bbedroom\b", r"\bbed\b"),
    ("living_room", r"\bliving room\b", r"\b(?:sofa|couch|coffee table|fireplace)\b"),
    ("dining_room", r"\bdining room\b", r"\b(?:table|chair)\b"),
    ("garage", r"\bgarage\b", r"\b(?:garage door|vehicle|car)\b"),
    ("corridor", r"\b(?:hallway|corridor)\b", r"\bdoor"),
    ("stair", r"\b(?:staircase|stairs|stairway)\b", None),
]
FLOOR_EVIDENCE = {
    "basement": r"\b(?:basement|below grade|underground|foundation wall)\b",
    "ground": r"\b(?:ground floor|street level|grade-level|at grade)\b",
    "upper": r"\b(?:upper floor|second floor|third floor|upstairs)\b",
    "attic": r"\b(?:attic|loft|eaves|roof rafters)\b",
}
PLACEHOLDER = r"(?i)^(?:possible|unknown|none|n/?a|not visible|not provided)$"
GENERATED_TAG = ("^(?:vlm-analyzed|scene:|room:|floor:|floor-number:|property-relevance:|address-match:|connection:"
                 "|reconstruction-excluded)")
PLAN_LABEL_RULES = [
    ("bathroom", r"\b(?:bath|bathroom|wc|lavatory|powder)\b"),
    ("bedroom", r"\b(?:bed|bedroom|master|primary)\b"),
    ("kitchen", r"\bkitchen\b"),
    ("living_room", r"\b(?:living|great room|family room|lounge)\b"),
    ("dining_room", r"\bdining\b"),
    ("office", r"\b(?:office|study)\b"),
    ("garage", r"\bgarage\b"),
    ("basement", r"\bbasement\b"),
    ("attic", r"\b(?:attic|loft)\b"),
    ("corridor", r"\b(?:hall|hallway|corridor|foyer|entry)\b"),
    ("closet", r"\b(?:closet|wardrobe|wic)\b"),
    ("stair", r"\b(?:stair|stairs|stairway)\b"),
    ("utility", r"\b(?:utility|laundry|mechanical|mech)\b"),
]
MIN_TOKEN_SCORE = 0.78
MAX_LABEL_CHARS = 48
MAX_PLAN_LABELS = 60
IGNORED_TOKEN = r"""(?i)(?:FLOOR\s+PLAN|\d+\s*["'°]|ROOF(?:\s+BELOW)?$|^[\d.\-=/ ]+$)"""
FLOOR_TITLE = r"\b(\d{1,2})(?:ST|ND|RD|R|TH)?\s+FLOOR\s+PLAN\b"
ROOM_WORDS = (r"(?i)\b(?:LIVING|FAMILY|DINING|KITCHEN|BED(?:ROOM)?|PRIMARY|MASTER|BATH(?:ROOM)?|LAUNDRY|HALL(?:WAY)?|"
              r"CORRIDOR|FOYER|ENTRY|CLOSET|WIC|GARAGE|UTILITY|MECH(?:ANICAL)?|OFFICE|STUDY|WORKOUT|PATIO|TERRACE|"
              r"BALCONY|ROOF\s*DECK|BASEMENT|ATTIC|PANTRY|MUD\s*ROOM)\b")
LEVEL_ANCHORS = [
    (r"(?i)\b(?:BASEMENT|LOWER)\s+(?:LEVEL|FLOOR)\b", 0, "Lower level"),
    (r"(?i)\b(?:MAIN|GROUND)\s+(?:LEVEL|FLOOR)\b", 1, "Main level"),
    (r"(?i)\b(?:UPPER|SECOND|2ND)\s+(?:LEVEL|FLOOR)\b", 2, "Upper level"),
    (r"(?i)\b(?:THIRD|3RD)\s+(?:LEVEL|FLOOR)\b", 3, "Third level"),
    (r"(?i)\b1ST\s+FLOOR(?:\s+PLAN)?\b", 1, "First floor"),
    (r"(?i)\b2ND\s+FLOOR(?:\s+PLAN)?\b", 2, "Second floor"),
    (r"(?i)\b3RD\s+FLOOR(?:\s+PLAN)?\b", 3, "Third floor"),
]
TACTICAL_TAGS = {
    "person": ("occupant", "critical"), "bed": ("possible concealment area", "attention"),
    "couch": ("possible concealment area", "attention"), "knife": ("sharp object", "critical"),
    "scissors": ("sharp object", "attention"), "oven": ("heat / gas appliance", "attention"),
    "toaster": ("heat appliance", "attention"), "microwave": ("electrical appliance", "attention"),
    "refrigerator": ("large appliance", "attention"),
}
MAX_DETECTIONS = 30
ANALYSIS_LIMIT = 50
MAX_MODEL_IMAGE_BYTES = 3 * 1024 * 1024


# --- L01: JSON out of model text

@F.pandas_udf(T.StringType())
def balanced_object(text: pd.Series) -> pd.Series:
    """First brace-balanced object of each text, honouring quotes and escapes."""
    def scan(value):
        if value is None:
            return None
        start = value.find("{")
        while start >= 0:
            depth, quoted, skip = 0, False, False
            for at in range(start, len(value)):
                ch = value[at]
                if quoted:
                    if skip:
                        skip = False
                    elif ch == "\\":
                        skip = True
                    else:
                        quoted = ch != '"'
                elif ch == '"':
                    quoted = True
                elif ch == "{":
                    depth += 1
                elif ch == "}":
                    depth -= 1
                    if depth == 0:
                        return value[start : at + 1]
            start = value.find("{", start + 1)
        return None

    return text.map(scan)


def unfenced(text: Column) -> Column:
    """The content of a code fence around the whole text, or the trimmed text."""
    plain = F.regexp_replace(text, r"^\s+|\s+$", "")
    inner = F.regexp_extract(plain, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(plain.rlike(r"(?is)^```(?:json)?\s*(.*?)\s*```$"), inner).otherwise(plain)


def valid_json(text: Column) -> Column:
    """Canonical text of a JSON object or array, NULL for anything else.

    The parser stops after the first value; inside brackets trailing words make
    it fail and a second value shows up as a second element.
    """
    def whole(v):
        lone = F.try_variant_get(v, "$[1]", "variant").isNull()
        return F.when(lone, F.try_variant_get(v, "$[0]", "string"))

    shaped = text.startswith("{") | text.startswith("[")
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(shaped, let(wrapped, whole))


def json_text(df: DataFrame, text: str, out: str = "json") -> DataFrame:
    """The JSON of a model answer; only answers that do not parse are scanned."""
    staged = df.withColumn("__c", unfenced(F.col(text))).withColumn("__ok", valid_json(F.col("__c")))
    scanned = balanced_object(F.when(F.col("__ok").isNull(), F.col("__c")))
    return staged.withColumn("__s", scanned).withColumn(out, F.coalesce("__ok", valid_json(F.col("__s")))) \
        .drop("__c", "__ok", "__s")


def json_between_braces(text: Column) -> Column:
    """L01, second variant: from the first '{' to the last '}'."""
    candidate = unfenced(text)
    return F.coalesce(valid_json(candidate), valid_json(F.regexp_extract(candidate, r"(?s)(\{.*\})", 1)))


# --- L02, L03: labelled prose and typed coercion

def labelled_value(text: Column, label: str) -> Column:
    found = F.trim(F.regexp_extract(text, rf"(?i)(?:^|\n)\s*{label}\s*[:=-]\s*([^\n]+)", 1))
    return F.nullif(found, F.lit(""))


def first_token(text: Column, allowed: list[str], fallback: Column) -> Column:
    """The first allowed word that the text contains, in the order of the list."""
    plain = F.regexp_replace(F.lower(text), r"[\s-]+", "_")
    chain = None
    for word in allowed:
        hit = plain.contains(word)
        chain = F.when(hit, word) if chain is None else chain.when(hit, word)
    return chain.otherwise(fallback)


def placeholder_blank(value: Column) -> Column:
    """Placeholders become the empty string."""
    trimmed = F.trim(value)
    return F.when(trimmed.rlike(PLACEHOLDER), "").otherwise(trimmed)


def parse_prose(text: Column) -> Column:
    """The analysis struct of 'label: value' lines."""
    def values(plain):
        return F.struct(
            plain.alias("plain"),
            F.coalesce(labelled_value(plain, r"scene(?:\s+type|Type)"), plain).alias("scene"),
            first_token(F.coalesce(labelled_value(plain, r"room(?:\s+type|Type)"), plain), PROSE_ROOMS,
                        F.lit("unknown")).alias("room"),
            F.coalesce(labelled_value(plain, r"floor(?:\s+hint|Hint)"), F.lit("unknown")).alias("floor"),
            F.coalesce(labelled_value(plain, r"property(?:\s+relevance|Relevance)"), F.lit("unknown")).alias("relevance"),
            F.coalesce(labelled_value(plain, r"observed(?:\s+address|Address)"), F.lit("")).alias("address"),
            F.coalesce(labelled_value(plain, "connections?"), F.lit("")).alias("connections"),
            F.coalesce(labelled_value(plain, "summary"), F.regexp_replace(plain, r"\s+", " ")).alias("summary"),
            F.regexp_extract(F.coalesce(labelled_value(plain, r"confidence(?:\s+score|Score)?"), F.lit("")),
                             r"(\d+(?:\.\d+)?)", 1).try_cast("double").alias("confidence"))

    def scened(v):
        fallback = F.when(v["room"] != "unknown", "interior").otherwise("unknown")
        return F.struct(v.alias("v"), first_token(v["scene"], PROSE_SCENES, fallback).alias("scene"))

    def analysis(s):
        v, scene = s["v"], s["scene"]
        relevance = F.when(scene == "non_property", "unlikely").when(scene.isin("interior", "exterior"), "likely") \
            .otherwise("unknown")
        score = F.coalesce(v["confidence"], F.lit(0.5))
        found = F.array_compact(F.array(*[
            F.when(v["connections"].rlike(r"(?i)\b" + c.replace("_", "[ _-]") + r"\b"), c) for c in PROSE_CONNECTIONS]))
        return F.struct(
            scene.alias("scene_type"), v["room"].alias("room_type"),
            first_token(v["floor"], FLOOR_HINTS, F.lit("unknown")).alias("floor_hint"),
            first_token(v["relevance"], PROSE_RELEVANCES, relevance).alias("relevance"),
            placeholder_blank(v["address"]).alias("observed_address"), found.alias("connections"),
            F.when(v["summary"] == "", "The vision model returned no visual summary.").otherwise(v["summary"])
            .alias("summary"),
            clamp(F.when(score > 1, score / 100).otherwise(score), 0.0, 1.0).alias("confidence_score"))

    plain = F.trim(F.regexp_replace(F.regexp_replace(text, "[*`#]", ""), "\r", ""))
    return let(let(let(plain, values), scened), analysis)


GENERATED_SCHEMA = ("sceneType string, roomType string, floorHint string, floorNumber int, roomLabels array<string>, "
                    "propertyRelevance string, observedAddress string, connections array<string>, summary string, "
                    "confidenceScore double")


def coerce_analysis(json: Column) -> Column:
    """The typed analysis, or NULL when a required field is missing or out of range."""
    def checked(g):
        labels = F.transform(F.coalesce(g["roomLabels"], F.array().cast("array<string>")), F.trim)
        links = F.coalesce(g["connections"], F.array().cast("array<string>"))
        summary = F.trim(g["summary"])
        ok = (
            g["sceneType"].isin(SCENE_TYPES) & g["roomType"].isin(ROOM_TYPES) & g["floorHint"].isin(FLOOR_HINTS)
            & g["propertyRelevance"].isin(RELEVANCES) & F.length(summary).between(1, 800)
            & (g["floorNumber"].isNull() | g["floorNumber"].between(-5, 200))
            & (g["confidenceScore"].isNull() | g["confidenceScore"].between(0.0, 1.0))
            & (F.size(labels) <= 40) & F.forall(labels, lambda x: F.length(x).between(1, 120))
            & (F.size(links) <= 12) & F.forall(links, lambda x: x.isin(CONNECTIONS))
            & (F.length(F.coalesce(F.trim(g["observedAddress"]), F.lit(""))) <= 300))
        value = F.struct(
            g["sceneType"].alias("scene_type"), g["roomType"].alias("room_type"), g["floorHint"].alias("floor_hint"),
            g["floorNumber"].alias("floor_number"), labels.alias("room_labels"),
            g["propertyRelevance"].alias("relevance"),
            F.coalesce(F.trim(g["observedAddress"]), F.lit("")).alias("observed_address"), links.alias("connections"),
            summary.alias("summary"), F.coalesce(g["confidenceScore"], F.lit(0.5)).alias("confidence_score"))
        return F.when(F.coalesce(ok, F.lit(False)), value)

    return let(F.from_json(json, GENERATED_SCHEMA), checked)


# --- L04 to L08: repair

def infer_room(summary: Column) -> Column:
    """Room named by a lower-case summary together with its furnishing, first rule wins."""
    chain = F.when(summary.rlike(r"\bkitchen\b") & (count_matches(summary, KITCHEN_TERMS) >= 2), "kitchen") \
        .when(summary.rlike(r"\bbathroom\b") & (count_matches(summary, BATHROOM_TERMS) >= 2), "bathroom")
    for room, first, second in ROOM_RULES:
        cond = summary.rlike(first) if second is None else summary.rlike(first) & summary.rlike(second)
        chain = chain.when(cond, room)
    return chain


def repair_scene(scene: Column, room: Column, relevance: Column, summary: Column) -> Column:
    """Struct of repaired scene, room and relevance; plans and non-property stay."""
    def repaired(s):
        low = s["summary"]
        fixed_room = (
            F.when((room == "kitchen") & low.rlike(LAUNDRY) & ~low.rlike(COOKING), "utility")
            .when((room == "unknown") & s["inferred"].isNotNull(), s["inferred"]).otherwise(room))
        indoor = fixed_room.isin(INDOOR_ROOMS)
        fixed_scene = (F.when(fixed_room == "exterior", "exterior")
                       .when(scene.isin("exterior", "unknown") & indoor, "interior").otherwise(scene))
        fixed_relevance = F.when((scene == "unknown") & (relevance == "unlikely") & s["inferred"].isNotNull(), "likely") \
            .otherwise(relevance)
        keep = scene.isin("floor_plan", "non_property")
        return F.struct(F.when(keep, scene).otherwise(fixed_scene).alias("scene_type"),
                        F.when(keep, room).otherwise(fixed_room).alias("room_type"),
                        F.when(keep, relevance).otherwise(fixed_relevance).alias("relevance"))

    low = F.lower(summary)
    return let(let(low, lambda s: F.struct(s.alias("summary"), infer_room(s).alias("inferred"))), repaired)


def verified_floor(hint: Column, summary: Column) -> Column:
    """The floor hint only if the text supports it."""
    chain = None
    for name, pattern in FLOOR_EVIDENCE.items():
        cond = (hint == name) & F.lower(summary).rlike(pattern)
        chain = F.when(cond, name) if chain is None else chain.when(cond, name)
    return chain.otherwise("unknown")


def rejected_view(scene: Column, relevance: Column, address_match: Column) -> Column:
    return (scene == "non_property") | (relevance == "unlikely") | (address_match == "contradictory")


def analysed_tags(tags: Column, a: dict[str, Column]) -> Column:
    """Generated tags replaced, distinct in order, exclusion added when rejected."""
    def tag(prefix, value):
        return F.when(value.isNotNull(), F.concat(F.lit(prefix), value.cast("string")))

    fresh = F.array_compact(F.concat(
        F.array(F.lit("vlm-analyzed"), tag("scene:", a["scene_type"]), tag("room:", a["room_type"]),
                tag("floor:", a["floor_hint"]), tag("floor-number:", a["floor_number"]),
                tag("property-relevance:", a["relevance"]), tag("address-match:", a["address_match"])),
        F.transform(a["connections"], lambda c: F.concat(F.lit("connection:"), c)),
        F.array(F.when(rejected_view(a["scene_type"], a["relevance"], a["address_match"]), "reconstruction-excluded"))))
    return F.array_distinct(F.concat(F.filter(tags, lambda t: ~t.rlike(GENERATED_TAG)), fresh))


def analysed_kind(scene: Column, tags: Column) -> Column:
    """Plans become blueprints, everything else an image."""
    plan = (scene == "floor_plan") | F.array_contains(tags, "plan-candidate")
    return F.when(plan, "blueprint").otherwise("image")


# --- L09 to L17: selection, catalogues and findings

def pending_images(evidence: DataFrame, analysed: DataFrame, *, case: str, key: str, order: list[Column],
                   eligible: Column, force: bool = False, limit: int = ANALYSIS_LIMIT) -> DataFrame:
    """The next images to analyse per case."""
    rows = evidence.filter(eligible)
    if not force:
        rows = rows.join(analysed.select(key).distinct(), key, "left_anti")
    return top_k(rows, [case], order, limit, "pick")


def analysis_stats(df: DataFrame, *, case: str, ok: Column, rejected: Column) -> DataFrame:
    """Analysed, rejected and failed counts."""
    return df.groupBy(case).agg(F.count_if(ok).alias("analysed"), F.count_if(ok & rejected).alias("rejected"),
                                F.count_if(~ok).alias("warnings"))


def normal_label(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def plan_label_room(label: Column) -> Column:
    """Room type of a printed label, bath before bed."""
    def classify(value):
        chain = None
        for room, pattern in PLAN_LABEL_RULES:
            cond = value.rlike(pattern)
            chain = F.when(cond, room) if chain is None else chain.when(cond, room)
        return chain

    return let(normal_label(label), classify)


def printed_labels(tokens: DataFrame, *, sheet: str, text: str, score: str, order: list[Column],
                   limit: int = MAX_PLAN_LABELS) -> DataFrame:
    """The first labels of a sheet that are neither titles nor dimensions."""
    t = F.col(text)
    kept = tokens.filter((F.trim(t) != "") & (F.col(score) >= MIN_TOKEN_SCORE) & ~t.rlike(IGNORED_TOKEN)
                         & (F.length(t) <= MAX_LABEL_CHARS) & t.rlike(r"\p{L}"))
    return top_k(kept, [sheet], order, limit, "label_pos")


def sheet_floor(tokens: DataFrame, *, sheet: str, text: str, score: str, pos: Column) -> DataFrame:
    """Floor number of the first 'N FLOOR PLAN' title."""
    plain = F.regexp_replace(F.upper(text), r"\s+", " ")
    number = F.regexp_extract(plain, FLOOR_TITLE, 1).try_cast("int")
    titled = tokens.filter(F.col(score) >= MIN_TOKEN_SCORE).withColumn("__n", number).filter("__n is not null")
    return titled.groupBy(sheet).agg(F.min_by("__n", pos).alias("floor_number"))


def is_room_label(text: Column) -> Column:
    return text.rlike(ROOM_WORDS)


def level_anchor(text: Column) -> Column:
    """Floor number and label of a level title; the first matching pattern decides."""
    def classify(value):
        chain = None
        for pattern, number, label in LEVEL_ANCHORS:
            hit = F.struct(F.lit(number).alias("floor_number"), F.lit(label).alias("floor_label"))
            chain = F.when(value.rlike(pattern), hit) if chain is None else chain.when(value.rlike(pattern), hit)
        return chain

    return let(F.trim(F.regexp_replace(text, r"\s+", " ")), classify)


def site_sheets(tokens: DataFrame, *, sheet: str, text: str, position: str) -> DataFrame:
    """A sheet is a site plan when its text says so and no token anchors a level.

    The title may be split over a token and the one at the next ``position``.
    """
    after = tokens.select(sheet, (F.col(position) - 1).alias(position), F.col(text).alias("__next"))
    return tokens.join(after, [sheet, position], "left").groupBy(sheet).agg(
        F.bool_or(F.concat_ws(" ", text, "__next").rlike(r"(?i)\bSITE\s+PLAN\b")).alias("__site"),
        F.bool_or(level_anchor(F.col(text)).isNotNull()).alias("__anchored"),
    ).select(sheet, (F.col("__site") & ~F.col("__anchored")).alias("site_reference"))


def filter_detections(df: DataFrame, *, frame: str, order: list[Column], box: tuple[str, str, str, str], score: str,
                      label: str, ratio: Column, pad_x: Column, pad_y: Column, width: Column, height: Column,
                      threshold: float, limit: int = MAX_DETECTIONS) -> DataFrame:
    """Detections mapped back to the frame, normalised and tagged; first ``limit`` per frame."""
    x1, y1, x2, y2 = (F.col(c) for c in box)

    def back(v, pad, size):
        return F.least(size.cast("double"), F.greatest(F.lit(0.0), (v - pad) / ratio))

    left, right = back(x1, pad_x, width), back(x2, pad_x, width)
    top, bottom = back(y1, pad_y, height), back(y2, pad_y, height)
    boxed = df.filter((F.col(score) >= threshold) & F.col(label).isNotNull()).withColumn(
        "__b", F.struct(left.alias("l"), top.alias("t"), F.greatest(F.lit(0.0), right - left).alias("w"),
                        F.greatest(F.lit(0.0), bottom - top).alias("h")))
    kept = top_k(boxed.filter((F.col("__b.w") >= 1) & (F.col("__b.h") >= 1)), [frame], order, limit, "pick")
    tags = F.create_map(*[v for k, (name, level) in TACTICAL_TAGS.items() for v in (
        F.lit(k), F.struct(F.lit(name).alias("name"), F.lit(level).alias("level")))])
    tag = F.try_element_at(tags, F.col(label))
    return kept.withColumn("x", F.bround(F.col("__b.l") / width, 6)).withColumn("y", F.bround(F.col("__b.t") / height, 6)) \
        .withColumn("width", F.bround(F.col("__b.w") / width, 6)) \
        .withColumn("height", F.bround(F.col("__b.h") / height, 6)) \
        .withColumn("tactical_label", F.coalesce(tag["name"], F.lit("observed object"))) \
        .withColumn("priority", F.coalesce(tag["level"], F.lit("standard"))).drop("__b")


def cited_findings(findings: DataFrame, evidence: DataFrame, *, case: str, finding: str, cited: str,
                   evidence_id: str, with_image: Column) -> DataFrame:
    """Findings with the cited ids that exist in their case; others are dropped.

    Ids are checked by a semi-join on (case, id), so a case may hold any number
    of evidence rows.
    """
    ids = findings.select(case, finding, F.posexplode(F.array_distinct(cited)).alias("__pos", "__id"))
    known = evidence.select(case, F.col(evidence_id).alias("__id"))
    kept = ids.join(known, [case, "__id"], "left_semi").groupBy(case, finding).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__id"))), lambda s: s["__id"]).alias("source_ids"))
    return findings.join(kept, [case, finding]).withColumn(
        "confidence_score", F.when(with_image, 0.42).otherwise(0.28)).withColumn("review", F.lit("pending"))


def flag_for_review(cases: DataFrame, added: DataFrame, *, case: str, status: str) -> DataFrame:
    """A case with any added finding needs review."""
    touched = added.select(case).distinct().withColumn("__hit", F.lit(True))
    return cases.join(touched, case, "left").withColumn(
        status, F.when(F.col("__hit"), "review_required").otherwise(F.col(status))).drop("__hit")


def interior_gap(evidence: DataFrame, *, case: str, key: str) -> tuple[DataFrame, DataFrame]:
    """One advisory per case, and its citations as rows (all evidence of the case)."""
    gap = evidence.groupBy(case).agg(F.count(F.lit(1)).alias("source_count")).select(
        case, F.lit("Interior layout unknown").alias("label"), F.lit("intelligence_gap").alias("category"),
        F.lit("caution").alias("severity"), "source_count", F.lit(1.0).alias("confidence_score"))
    return gap, evidence.select(case, F.col(key).alias("source_id"))


def first_usable_image(evidence: DataFrame, files: DataFrame, *, case: str, path: str, order: list[Column],
                       size: str, max_bytes: int = MAX_MODEL_IMAGE_BYTES) -> DataFrame:
    """First local image per case that is on disk and not too large."""
    there = files.filter(F.col(size) <= max_bytes).select(path)
    return first_by(evidence.join(there, path, "left_semi"), [case], order)
