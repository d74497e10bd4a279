"""Address parsing, normalisation, scoring and candidate ranking."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofgrid.functions.text import let, squeeze, tokens
from proofgrid.operators.ranking import first_by

# Word lists of the address rules.
STREET_STOP_WORDS = ["street", "st", "avenue", "ave", "road", "rd", "drive", "dr", "lane", "ln", "boulevard",
                     "blvd", "court", "ct", "way", "unit", "home", "homes", "for", "sale", "zillow", "redfin"]
STATES = ["AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "DC", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS",
          "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC",
          "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
          "PR"]
STATE_ALIASES = {"NY": "new york", "CA": "california", "DC": "district of columbia", "WA": "washington",
                 "TX": "texas", "FL": "florida"}
ORDINAL_DIGITS = {"first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6",
                  "seventh": "7", "eighth": "8", "ninth": "9", "tenth": "10"}
ORDINAL_NAMES = {"first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th",
                 "sixth": "6th", "seventh": "7th", "eighth": "8th", "ninth": "9th", "tenth": "10th"}
STREET_SUFFIXES = {"ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive", "hwy": "highway",
                   "ln": "lane", "pkwy": "parkway", "pl": "place", "rd": "road", "st": "street"}
SIMILARITY_STOP_WORDS = ["street", "st", "avenue", "ave", "road", "rd", "boulevard", "blvd", "drive", "dr",
                         "lane", "ln", "the", "of"]
NUMBERED = r"^\s*\d+[A-Za-z-]*\b"
MIN_CANDIDATE_SCORE = 0.58
RANKED_CONFIDENCE_CAP = 0.82
EXACT_CONFIDENCE = 0.9


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _filled(c: Column) -> Column:
    return _text(c) != ""


def _mapped(token: Column, table: dict[str, str]) -> Column:
    m = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(F.try_element_at(m, token), token)


def house_token(words: Column) -> Column:
    return F.get(F.filter(words, lambda t: t.rlike(r"^\d+[a-z]?$")), 0)


def _street_terms(words: Column, house: Column) -> Column:
    return F.filter(words, lambda t: ~t.eqNullSafe(house) & ~t.isin(STREET_STOP_WORDS) & ~t.rlike(r"^\d{5}$"))


def address_text_match(address: Column, text: Column) -> Column:
    """The text carries the same first house number and enough street terms."""
    def terms(words):
        return F.struct(house_token(words).alias("house"), words.alias("words"))

    def street(side):
        return _street_terms(side["words"], side["house"])

    def compare(p):
        shared = F.size(F.filter(p["want"], lambda t: F.array_contains(p["have"], t)))
        return p["same"] & (shared >= F.least(F.lit(2), F.size(p["want"])))

    def sides(q):
        return F.struct(F.coalesce(q["a"]["house"] == q["b"]["house"], F.lit(False)).alias("same"),
                        street(q["a"]).alias("want"), street(q["b"]).alias("have"))

    both = F.struct(let(tokens(_text(address)), terms).alias("a"), let(tokens(_text(text)), terms).alias("b"))
    return let(let(both, sides), compare)


def comma_parts(address: Column) -> Column:
    return F.filter(F.transform(F.split(address, ","), lambda p: F.trim(p)), lambda p: p != "")


def normal_number(value: Column) -> Column:
    return F.ltrim(F.lower(F.trim(value)), F.lit("0"))


def find_state(address: Column) -> Column:
    """First listed two-letter code standing alone between separators."""
    codes = F.regexp_extract_all(F.upper(address), F.lit(r"(?:^|[,\s])([A-Z]{2})(?=[,\s]|$)"), F.lit(1))
    return F.get(F.filter(codes, lambda c: c.isin(STATES)), 0)


def _extract(text: Column, pattern: str, group: int = 1) -> Column:
    return let(F.regexp_extract(text, pattern, group), lambda found: F.when(found != "", found))


def address_parts(address: Column) -> Column:
    """Struct of house number, street, city, state, postcode."""
    def split_up(parts):
        numbered = F.transform(parts, lambda p: p.rlike(NUMBERED))
        at = F.greatest(F.array_position(numbered, True).cast("int") - 1, F.lit(0))
        return F.struct(F.coalesce(F.get(parts, at), address).alias("street"), F.get(parts, at + 1).alias("city"))

    def assemble(s):
        return F.struct(
            normal_number(_extract(s["street"], r"^\s*(\d+[A-Za-z-]*)\b")).alias("house_number"),
            s["street"].alias("street"), s["city"].alias("city"), find_state(address).alias("state"),
            _extract(address, r"\b(\d{5})(?:-\d{4})?\b").alias("postcode"))

    return let(let(comma_parts(address), split_up), assemble)


def leading_place_name(address: Column) -> Column:
    """First comma part when it is a name that stands before a numbered part."""
    numbered = r"^\d+[A-Za-z-]*\b"

    def first_name(parts):
        rest = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
        ok = (F.size(parts) >= 3) & ~F.get(parts, 0).rlike(numbered) & F.exists(rest, lambda p: p.rlike(numbered))
        return F.when(ok, F.get(parts, 0))

    return let(comma_parts(address), first_name)


def without_place_name(address: Column) -> Column:
    """The address after its leading place name."""
    parts = comma_parts(address)
    rest = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), ", ")
    return F.when(leading_place_name(address).isNotNull(), rest).otherwise(address)


def similarity_tokens(text: Column) -> Column:
    """Distinct tokens without ordinal endings, punctuation and street-type words."""
    plain = F.regexp_replace(F.lower(_text(text)), r"(\d+)(?:st|nd|rd|th)\b", "$1")
    words = F.split(F.regexp_replace(plain, r"[\p{P}\p{S}]+", " "), r"[\s\p{Z}]+")
    mapped = F.transform(words, lambda t: _mapped(t, ORDINAL_DIGITS))
    return F.array_distinct(F.filter(mapped, lambda t: (t != "") & ~t.isin(SIMILARITY_STOP_WORDS)))


def normal_text(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(_text(text)), r"(\d+)(?:st|nd|rd|th)\b", "$1")
    words = F.split(F.regexp_replace(plain, r"[\p{P}\p{S}]+", " "), r"[\s\p{Z}]+")
    mapped = F.transform(words, lambda t: _mapped(t, ORDINAL_DIGITS))
    return F.array_join(F.filter(mapped, lambda t: (t != "") & ~t.isin(SIMILARITY_STOP_WORDS)), " ")


def token_similarity(left: Column, right: Column) -> Column:
    """Shared tokens over the larger set; 0 when either is empty."""
    def ratio(p):
        a, b = p["a"], p["b"]
        return F.when(F.least(F.size(a), F.size(b)) == 0, F.lit(0.0)).otherwise(
            F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))

    return let(F.struct(similarity_tokens(left).alias("a"), similarity_tokens(right).alias("b")), ratio)


def state_matches(code: Column, name: Column) -> Column:
    """Equal code, or one of six spelled-out aliases."""
    alias = F.create_map(*[F.lit(v) for kv in STATE_ALIASES.items() for v in kv])
    return let(normal_text(name), lambda plain: (plain == F.lower(code)) | F.coalesce(F.try_element_at(alias, code) == plain, F.lit(False)))


def parsed_request(address: Column) -> Column:
    """What A05 needs of a request; parse it once, before candidates multiply the rows."""
    return F.struct(address_parts(address).alias("parts"), leading_place_name(address).alias("place"))


def candidate_score(request: Column, c: dict[str, Column]) -> Column:
    """Score of one gazetteer candidate against a parsed request, 0..1.

    ``c`` holds lat, lon, name, display_name, importance, house_number, road,
    locality, state, postcode.  Candidates without a place, with another house number, or with another postcode and no
    name to outweigh it are 0 whatever else they say; that is looked at first, in plain expressions.
    """
    asked = request["parts"]
    postcode = F.regexp_extract(_text(c["postcode"]), r"(\d{5})", 1)
    same_post = F.coalesce((asked["postcode"] == postcode) & (postcode != ""), F.lit(False))
    other_house = _filled(asked["house_number"]) & _filled(c["house_number"]) & (
        normal_number(_text(c["house_number"])) != asked["house_number"])
    hopeless = (~_filled(c["lat"]) | ~_filled(c["lon"]) | ~_filled(c["display_name"]) | other_house
                | (request["place"].isNull() & _filled(asked["postcode"]) & ~same_post))

    def measure(w):
        want = w["parts"]
        has_house, asks_house = _filled(c["house_number"]), _filled(want["house_number"])
        both_states = _filled(want["state"]) & _filled(c["state"])
        plain = (
            ~(both_states & ~F.coalesce(state_matches(want["state"], c["state"]), F.lit(False))))
        return F.struct(
            want.alias("want"), w["place"].alias("place"), F.coalesce(plain, F.lit(False)).alias("plausible"), _filled(want["postcode"]).alias("asks_post"),
            same_post.alias("same_post"),
            asks_house.alias("asks_house"), has_house.alias("has_house"), both_states.alias("both_states"),
            (_filled(want["city"]) & _filled(c["locality"])).alias("both_cities"))

    def named(m):
        # token work only for candidates the plain checks leave standing
        found_name = F.coalesce(c["name"], F.get(F.split(c["display_name"], ","), 0), F.lit(""))
        return F.struct(m.alias("m"), F.when(m["place"].isNull() | ~m["plausible"], F.lit(0.0)).otherwise(
            token_similarity(m["place"], found_name)).alias("name"))

    def compare(n):
        m = n["m"]
        alive = m["plausible"] & ~(m["asks_post"] & ~m["same_post"] & (n["name"] < 0.75))
        return F.struct(
            m.alias("m"), n["name"].alias("name"), alive.alias("alive"),
            F.when(alive & m["both_cities"], token_similarity(m["want"]["city"], c["locality"])).otherwise(0.0).alias("city"),
            F.when(alive & _filled(c["road"]), token_similarity(m["want"]["street"], c["road"])).otherwise(0.0).alias("road"))

    def total(r):
        m = r["m"]
        rejected = ~r["alive"] | (m["both_cities"] & (r["city"] < 0.5))
        importance = F.greatest(F.lit(0.0), F.coalesce(c["importance"], F.lit(0.0))) * 0.04
        score = (
            F.lit(0.28) + F.when(m["asks_post"] & m["same_post"], 0.24).otherwise(0.0)
            + F.when(m["asks_house"] & m["has_house"], 0.2).when(m["asks_house"], 0.04).otherwise(0.0)
            + r["road"] * 0.16 + F.when(m["both_cities"], r["city"] * 0.1).otherwise(0.0)
            + F.when(m["both_states"], 0.08).otherwise(0.0) + F.least(F.lit(0.04), importance) + r["name"] * 0.18)
        return F.when(rejected, F.lit(0.0)).otherwise(F.least(F.lit(1.0), score))

    return F.when(hopeless, F.lit(0.0)).otherwise(let(let(let(let(request, measure), named), compare), total))


def rank_candidates(df: DataFrame, *, request: str, score: str, pos: str, lat: str, lon: str) -> DataFrame:
    """Best candidate per request; none when its coordinates are not finite."""
    best = first_by(df.filter(F.col(score) >= MIN_CANDIDATE_SCORE), [request], [F.col(score).desc(), F.col(pos)])
    finite = F.col(lat).try_cast("double").isNotNull() & F.col(lon).try_cast("double").isNotNull() \
        & ~F.isnan(F.col(lat).try_cast("double")) & ~F.isnan(F.col(lon).try_cast("double"))
    return best.filter(finite).withColumn("confidence", F.least(F.lit(RANKED_CONFIDENCE_CAP), F.col(score)))


def exact_match(df: DataFrame, *, request: str, address: str, pos: str, house: str, zip_code: str,
                state: str) -> DataFrame:
    """First structure whose known parts do not conflict with the request.

    ``address`` names the request's text, or its ``address_parts``, made once before candidates multiply the rows.
    """
    want = F.col(address)
    if not isinstance(df.schema[address].dataType, T.StructType):
        want = address_parts(want)

    def conflict(ours: Column, theirs: Column) -> Column:
        return _filled(ours) & _filled(theirs) & (ours != theirs)

    bad = (conflict(want["house_number"], normal_number(F.col(house)))
           | conflict(want["postcode"], F.substring(F.col(zip_code), 1, 5))
           | conflict(want["state"], F.upper(F.col(state))))
    return first_by(df.filter(~F.coalesce(bad, F.lit(False))), [request], [F.col(pos)]) \
        .withColumn("confidence", F.lit(EXACT_CONFIDENCE))


def resolve(requests: DataFrame, *, key: str, address: str, ranked: DataFrame, exact: DataFrame,
            place: str) -> DataFrame:
    """Named place, then exact structure, then ranked place.

    ``ranked`` and ``exact`` hold one row per request with the ``place`` id.
    """
    r = ranked.select(key, F.col(place).alias("__ranked"))
    e = exact.select(key, F.col(place).alias("__exact"))
    named = leading_place_name(F.col(address)).isNotNull()
    local = country_gate(F.col(address))
    both = requests.join(r, key, "left").join(e, key, "left")
    use_ranked = named & F.col("__ranked").isNotNull()
    use_exact = local & F.col("__exact").isNotNull()
    return both.withColumn("method", F.when(use_ranked, "ranked").when(use_exact, "exact").when(
        F.col("__ranked").isNotNull(), "ranked")).withColumn(
        place, F.when(F.col("method") == "exact", F.col("__exact")).when(F.col("method") == "ranked", F.col("__ranked"))
    ).drop("__ranked", "__exact")


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode decompositions."""
    pairs = []
    for code in range(0xC0, 0x250):
        letter = chr(code)
        base = unicodedata.normalize("NFKD", letter)[0]
        if letter == letter.lower() and base != letter and base in "abcdefghijklmnopqrstuvwxyz":
            pairs.append((letter, base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


ACCENTS = _accent_table()


def normal_address(text: Column) -> Column:
    """Plain lower-case words with expanded suffixes and numeric ordinals.

    Canonical decomposition leaves a separator where an accent was, so a
    precomposed letter becomes the base letter followed by a space.
    """
    lower = F.lower(_text(text))
    spaced = F.regexp_replace(lower, f"([{ACCENTS[0]}])", "$1 ")
    words = tokens(F.translate(spaced, *ACCENTS))
    table = {**STREET_SUFFIXES, **ORDINAL_NAMES}
    return F.array_join(F.transform(words, lambda t: _mapped(t, table)), " ")


def measured_match(tags: Column, relevance: Column, expected: Column, observed: Column) -> Column:
    """A10: how an image's observed address relates to the case address; order matters."""
    def has(tag):
        return F.coalesce(F.array_contains(tags, tag), F.lit(False))

    want, seen = evidence_house_number(expected), evidence_house_number(observed)
    both = F.coalesce((want != "") & (seen != ""), F.lit(False))
    tagged = has("address-text-match") | has("listing-address-match")
    return (
        F.when(F.coalesce(relevance == "unlikely", F.lit(False)), "contradictory")
        .when(has("operator-upload"), "possible")
        .when(both & (want == seen), "supported").when(both, "contradictory")
        .when(tagged, "possible").otherwise("unknown")
    )


def evidence_house_number(text: Column) -> Column:
    return F.lower(F.regexp_extract(_text(text), r"(?:^|\s)(\d+[A-Za-z]?)(?:\s|$)", 1))


def query_variants(*candidates: Column) -> Column:
    """Distinct squeezed candidate texts in order, blanks dropped."""
    filled = F.filter(F.array(*candidates), lambda c: c.isNotNull() & (F.trim(c) != ""))
    return F.array_distinct(F.transform(filled, squeeze))


def title_case(text: Column) -> Column:
    """Capitalise after every non-word character; six state codes stay upper case."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\w+|\W+)"), F.lit(1))
    out = F.array_join(F.transform(runs, lambda r: F.concat(
        F.upper(F.substring(r, 1, 1)), F.right(r, F.length(r) - 1))), "")
    for code in STATE_ALIASES:
        out = F.regexp_replace(out, rf"\b{code.capitalize()}\b", code)
    return out


def country_gate(address: Column) -> Column:
    """A five-digit code or a listed state code."""
    return F.coalesce(address.rlike(r"\b\d{5}(?:-\d{4})?\b"), F.lit(False)) | find_state(address).isNotNull()
