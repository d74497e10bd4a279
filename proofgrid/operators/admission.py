"""Admission checks: types, signatures, quotas, shapes, digests and contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.functions.text import compact_reasons
from proofgrid.operators.ranking import join_back, running_sum

# Accepted types, signatures, limits and thresholds.
MIME_EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp", "application/pdf": ".pdf"}
IMAGE_TYPES = ["image/jpeg", "image/png", "image/webp"]
MAX_FILES = 50
MAX_BATCH_BYTES = 1024 * 1024 * 1024
MAX_REMOTE_BYTES = 20 * 1024 * 1024
PANORAMA_RATIO = 1.85
COVERAGE_DEGREES = {"panorama_360": 360, "panorama_180": 180}
PERSPECTIVE_DEGREES = 62
ID_PATTERN = "^[A-Za-z0-9_-]{8,128}$"
SHA_PATTERN = "^[0-9a-f]{64}$"
JOB_MODES = ["single_image", "panorama", "multi_image", "floorplan"]


def file_extension(mime: Column, allow_pdf: bool = True) -> Column:
    """Extension of an accepted type, NULL for any other."""
    table = {m: e for m, e in MIME_EXTENSIONS.items() if allow_pdf or m in IMAGE_TYPES}
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), mime)


def signature_matches(content: Column, mime: Column) -> Column:
    """The leading bytes fit the declared type."""
    def head(start, length):
        return F.hex(F.substring(content, start, length))

    return F.coalesce(
        F.when(mime == "image/jpeg", head(1, 2) == "FFD8")
        .when(mime == "image/png", head(1, 8) == "89504E470D0A1A0A")
        .when(mime == "image/webp", (head(1, 4) == "52494646") & (head(9, 4) == "57454250")), F.lit(False))


def batch_quota(df: DataFrame, *, batch: str, size: str, max_files: int = MAX_FILES,
                max_bytes: int = MAX_BATCH_BYTES) -> DataFrame:
    """The whole batch is rejected when it has too many files or bytes."""
    facts = df.groupBy(batch).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))
    return facts.withColumn("accepted", (F.col("files") <= max_files) & (F.col("bytes") <= max_bytes))


def first_over_quota(df: DataFrame, *, batch: str, size: str, order: list[Column], max_bytes: int,
                     slice_by: Column | None = None) -> DataFrame:
    """The row at which each batch first exceeds the byte limit."""
    run = running_sum(df, [batch], order, F.col(size), "running_bytes", slice_by)
    over = run.filter(F.col("running_bytes") > max_bytes)
    cols = [c for c in over.columns if c != batch]
    return over.groupBy(batch).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select(batch, "r.*")


def resolve_projection(df: DataFrame, *, batch: str, requested: str, width: str, height: str,
                       out: str = "projection") -> DataFrame:
    """V04: 'auto' is a 360 panorama for a single wide photo, else perspective."""
    counts = df.groupBy(batch).agg(F.count(F.lit(1)).alias("__n"))
    wide = F.coalesce(F.col(width) / F.nullif(F.col(height), F.lit(0)) >= PANORAMA_RATIO, F.lit(False))
    value = (F.when(F.col(requested) != "auto", F.col(requested))
             .when((F.col("__n") == 1) & wide, "panorama_360").otherwise("perspective"))
    return join_back(df, counts, [batch]).withColumn(out, value).drop("__n")


def capture_info(projection: Column, order: Column, overlap_set: Column, width: Column, height: Column,
                 requested: Column) -> Column:
    """Capture struct with coverage, size floor of one and where the projection came from."""
    coverage = F.lit(PERSPECTIVE_DEGREES)
    for name, degrees in COVERAGE_DEGREES.items():
        coverage = F.when(projection == name, degrees).otherwise(coverage)
    source = (F.when(requested != "auto", "operator").when(projection == "panorama_360", "aspect_ratio")
              .otherwise("default"))
    return F.struct(
        projection.alias("projection"), F.greatest(F.lit(1), F.coalesce(width, F.lit(1))).alias("width"),
        F.greatest(F.lit(1), F.coalesce(height, F.lit(1))).alias("height"), coverage.alias("coverage_degrees"),
        order.alias("capture_order"), overlap_set.alias("overlap_set_id"), source.alias("projection_source"))


def panorama_problem(projection: Column, width: Column, height: Column) -> Column:
    """Why the shape does not fit the declared projection; NULL when it does."""
    known = (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0)
    ratio = width / F.nullif(height, F.lit(0))
    return (
        F.when(projection == "perspective", None).when(~known, "dimensions_unreadable")
        .when((projection == "panorama_180") & ~ratio.between(0.9, 1.1), "half_sphere_needs_1_to_1")
        .when((projection == "panorama_360") & ~ratio.between(1.9, 2.1), "full_sphere_needs_2_to_1"))


def worker_panorama_problem(width: Column, height: Column) -> Column:
    """The worker's own guard: minimum size, 1:1 allowed, otherwise landscape."""
    ratio = width / F.nullif(height, F.lit(0))
    return (F.when((width < 128) | (height < 64), "too_small").when(ratio.between(0.9, 1.1), None)
            .when(ratio < 1.2, "not_landscape"))


def oriented_size(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """Orientations 5 to 8 swap the axes."""
    swap = F.coalesce(orientation.between(5, 8), F.lit(False))
    return F.when(swap, height).otherwise(width), F.when(swap, width).otherwise(height)


def page_likeness(pixels: DataFrame, *, image: str, channels: tuple[str, str, str], grey: str) -> DataFrame:
    """Channel statistics and grey entropy per image, and whether it looks like a printed page."""
    r, g, b = channels
    levels = pixels.groupBy(image, F.floor(F.col(grey)).alias("__g")).agg(
        F.count(F.lit(1)).alias("__c"),
        *[F.sum(c).alias(f"__s{c}") for c in channels],
        *[F.sum(F.col(c) * F.col(c)).alias(f"__q{c}") for c in channels])
    stats = levels.groupBy(image).agg(
        F.sum("__c").alias("__n"), F.sum(F.col("__c") * F.log2("__c")).alias("__clog"),
        *[F.sum(f"__s{c}").alias(f"__s{c}") for c in channels],
        *[F.sum(f"__q{c}").alias(f"__q{c}") for c in channels])
    n = F.col("__n")
    means = [F.col(f"__s{c}") / n for c in channels]
    # sample deviation, as image statistics report it
    devs = [F.sqrt(F.greatest(F.lit(0.0), (F.col(f"__q{c}") - F.col(f"__s{c}") * F.col(f"__s{c}") / n)
                              / F.greatest(n - 1, F.lit(1)))) for c in channels]
    out = stats.select(
        image, ((means[0] + means[1] + means[2]) / 3).alias("mean"),
        (F.greatest(*means) - F.least(*means)).alias("spread"), ((devs[0] + devs[1] + devs[2]) / 3).alias("deviation"),
        (F.log2(n) - F.col("__clog") / n).alias("entropy"))
    like = (F.col("mean") >= 215) & (F.col("spread") <= 22) & F.col("deviation").between(8, 65) \
        & F.col("entropy").between(0.5, 4.6)
    return out.withColumn("page_like", like)


def reconcile_digests(expected: DataFrame, actual: DataFrame, *, key: str, digest: str) -> DataFrame:
    """Per file whether it exists and its digest is equal."""
    there = actual.select(key, F.col(digest).alias("__actual"))
    return expected.join(there, key, "left").withColumn("exists", F.col("__actual").isNotNull()).withColumn(
        "match", F.coalesce(F.lower(digest) == F.lower("__actual"), F.lit(False))).drop("__actual")


def all_match(reconciled: DataFrame, *, job: str) -> DataFrame:
    """A job is verified when every input is."""
    return reconciled.groupBy(job).agg(F.bool_and("match").alias("verified"))


def job_problems(c: dict[str, Column]) -> Column:
    """Contract violations of grouped jobs, as an array of names.

    ``c`` holds job_id, mode, input_sha256, input_paths, evidence_ids,
    input_sha256s, floor_numbers.
    """
    grouped = c["mode"].isin("multi_image", "floorplan")
    sizes = F.array(*[F.coalesce(F.size(c[n]), F.lit(0)) for n in ("input_paths", "evidence_ids", "input_sha256s")])
    absent = F.exists(sizes, lambda n: n <= 0)
    unequal = F.array_min(sizes) != F.array_max(sizes)
    digests = F.transform(c["input_sha256s"], F.lower)
    return compact_reasons(
        (~c["job_id"].rlike(ID_PATTERN) | F.exists(c["evidence_ids"], lambda e: ~e.rlike(ID_PATTERN)), "bad_identifier"),
        (~F.lower(c["input_sha256"]).rlike(SHA_PATTERN) | F.exists(digests, lambda d: ~d.rlike(SHA_PATTERN)),
         "bad_digest"),
        (~c["mode"].isin(JOB_MODES), "bad_mode"),
        (grouped & absent, "grouped_fields_missing"),
        (grouped & ~absent & unequal, "counts_differ"),
        ((c["mode"] == "multi_image") & (sizes[0] < 2), "needs_two_inputs"),
        ((c["mode"] == "floorplan") & ~F.coalesce(F.size(c["floor_numbers"]) == sizes[0], F.lit(False)),
         "floor_number_per_plan"),
        (grouped & (F.lower(c["input_sha256"]) != F.get(digests, 0)), "first_digest_differs"),
        (grouped & (F.size(F.array_distinct(c["input_paths"])) < sizes[0]), "inputs_repeat"),
        (~grouped & c["input_sha256s"].isNotNull(), "digests_only_for_grouped"),
    )


def validate(df: DataFrame, rules: list[tuple[Column, str]], out: str = "problems") -> DataFrame:
    """Names of all violated rules per row; an empty array means valid."""
    return df.withColumn(out, compact_reasons(*rules))


def split_valid(df: DataFrame, out: str = "problems") -> tuple[DataFrame, DataFrame]:
    """The valid rows and the quarantine."""
    return df.filter(F.size(out) == 0), df.filter(F.size(out) > 0)


def id_set(ids: Column) -> Column:
    """Distinct ids in first-seen order."""
    return F.array_distinct(ids)


def id_signature(ids: Column) -> Column:
    """Sorted distinct ids joined by NUL."""
    return F.array_join(F.array_sort(F.array_distinct(ids)), "\0")


def same_id_set(a: Column, b: Column) -> Column:
    """Same length and every id of one in the other."""
    return (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0)


def drifted(before: DataFrame, after: DataFrame, *, key: str, digest: str) -> DataFrame:
    """Inputs whose digest changed or vanished between two snapshots."""
    later = after.select(key, F.col(digest).alias("__after"))
    return before.join(later, key, "left").filter(~F.col(digest).eqNullSafe(F.col("__after"))).drop("__after")


def confidence(score: Column, band: str, state: str, rationale: str, sources: Column, now: Column) -> Column:
    """The confidence struct used by every record; ``now`` is a parameter."""
    return F.struct(score.cast("double").alias("score"), F.lit(band).alias("band"), F.lit(state).alias("state"),
                    F.lit(rationale).alias("rationale"), sources.cast("int").alias("source_count"),
                    now.alias("updated_at"))


def unknown_confidence(rationale: str, now: Column) -> Column:
    """The confidence of something not established."""
    return confidence(F.lit(0.0), "unknown", "unknown", rationale, F.lit(0), now)
