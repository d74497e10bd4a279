"""Address rules on orders (requests) and the suppliers of their lines (candidates)."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.operators import address as adr
from proofgrid.operators.ranking import join_back
from proofgrid.plans.registry import query

STREETS = ["Oak Street", "Fifth Avenue", "Old Mill Road", "Elm Lane"]


def pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def requests(t):
    """One requested address per order, written out as text."""
    k = F.col("o_custkey")
    text = F.concat_ws(", ", F.when(F.col("o_orderkey") % 4 == 0, "Harbor Tower"),
                       F.concat((k % 3 + 1).cast("string"), F.lit(" "), pick(STREETS, k % 4)),
                       F.concat(F.lit("City"), (k % 2).cast("string")),
                       F.concat(pick(["NY", "CA"], k % 2), F.lit(" 1000"), (k % 2).cast("string")))
    return t.orders.select("o_orderkey", "o_custkey", text.alias("address"))


def candidates(t):
    """The gazetteer rows a request brought back: one per order line."""
    s = F.col("l_suppkey")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey"),
        F.when(s % 50 != 7, F.lit("40.5")).alias("lat"), F.when(s % 50 == 9, "n/a").otherwise("-74.0").alias("lon"),
        F.when(s % 6 == 0, "Harbor Tower").alias("name"), F.concat(F.lit("Place "), s.cast("string")).alias("display_name"),
        ((s % 10) / 10.0).alias("importance"), F.when(s % 5 != 0, (s % 3 + 1).cast("string")).alias("house_number"),
        F.when(s % 7 != 0, pick(["oak st", "5th avenue", "Mill Rd", "Pine"], s % 4)).alias("road"),
        F.concat(F.lit("City"), (s % 2).cast("string")).alias("locality"),
        pick(["New York", "california", "NY", "CA"], s % 4).alias("state"),
        F.concat(F.lit("1000"), (s % 2).cast("string")).alias("postcode"))


FACTS = """
    c as (select l.*, o.o_custkey k, l_suppkey s, o.o_orderkey % 4 = 0 as named,
        l_suppkey % 50 <> 7 has_lat, l_suppkey % 5 <> 0 has_house, l_suppkey % 7 <> 0 has_road,
        case l_suppkey % 4 when 0 then 'NY' when 2 then 'NY' else 'CA' end cand_state
      from lineitem l join orders o on l_orderkey = o_orderkey),
    sim as (select *, case when named and s % 6 = 0 then 1.0 else 0.0 end name_sim,
        k % 2 = s % 2 post_eq,
        case when k % 4 = s % 4 then case s % 4 when 0 then 1/2.0 when 1 then 1/2.0 when 2 then 1/3.0 else 0 end else 0 end road_sim,
        case when k % 2 = s % 2 then 1.0 else 0.0 end city_sim,
        cand_state = case k % 2 when 0 then 'NY' else 'CA' end state_eq from c),
    scored as (select *, case when not has_lat or (not post_eq and name_sim < 0.75) or (has_house and s % 3 <> k % 3)
        or not state_eq or city_sim < 0.5 then 0.0
      else least(1.0, 0.28 + case when post_eq then 0.24 else 0 end + case when has_house then 0.2 else 0.04 end
        + case when has_road then 0.16 * road_sim else 0 end + 0.1 * city_sim + 0.08
        + least(0.04, (s % 10) / 10.0 * 0.04) + 0.18 * name_sim) end score from sim)"""


def scored(t):
    parsed = requests(t).withColumn("request", adr.parsed_request(F.col("address")))
    c = candidates(t).join(parsed, F.col("l_orderkey") == F.col("o_orderkey"))
    cols = {n: F.col(n) for n in ("lat", "lon", "name", "display_name", "importance", "house_number", "road",
                                  "locality", "state", "postcode")}
    return c.withColumn("score", adr.candidate_score(F.col("request"), cols))


@query("a01_address_text_match", """
    select o_orderkey, o_custkey % 3 = o_orderkey % 3 and o_custkey % 4 = o_orderkey % 4 as matched from orders""")
def a01(t):
    o = F.col("o_orderkey")
    streets = ["Oak Hill Street", "Fifth Green Avenue", "Old Mill Road", "Elm Park Lane"]
    address = F.concat((F.col("o_custkey") % 3 + 1).cast("string"), F.lit(" "), pick(streets, F.col("o_custkey") % 4))
    text = F.concat(F.lit("For sale: "), (o % 3 + 1).cast("string"), F.lit(" "), F.upper(pick(streets, o % 4)),
                    F.lit(", 10001 | homes"))
    return t.orders.select("o_orderkey", adr.address_text_match(address, text).alias("matched"))


@query("a02_address_parts", """
    select o_orderkey, (o_custkey % 3 + 1)::varchar as house_number,
      (o_custkey % 3 + 1) || ' ' || case o_custkey % 4 when 0 then 'Oak Street' when 1 then 'Fifth Avenue' when 2 then 'Old Mill Road' else 'Elm Lane' end as street,
      'City' || o_custkey % 2 as city, case o_custkey % 2 when 0 then 'NY' else 'CA' end as state,
      '1000' || o_custkey % 2 as postcode from orders""")
def a02(t):
    return requests(t).select("o_orderkey", adr.address_parts(F.col("address")).alias("p")).select("o_orderkey", "p.*")


@query("a03_leading_place", """
    select o_orderkey, case when o_orderkey % 4 = 0 then 'Harbor Tower' end as place,
      starts_with(case when o_orderkey % 4 = 0 then 'x' else '' end, 'x') as named from orders""")
def a03(t):
    a = F.col("address")
    return requests(t).select("o_orderkey", adr.leading_place_name(a).alias("place"),
                              (adr.without_place_name(a) != a).alias("named"))


@query("a04_token_similarity", """
    select o_orderkey, round(case when o_custkey % 4 = o_orderkey % 4 then 1.0 else 0.0 end, 6) as similarity from orders""")
def a04(t):
    left = pick(["1st Oak Street", "The Fifth Avenue", "Mill Road", "Lane of Elm"], F.col("o_custkey") % 4)
    right = pick(["first oak", "5 ave", "MILL", "elm."], F.col("o_orderkey") % 4)
    return t.orders.select("o_orderkey", F.round(adr.token_similarity(left, right), 6).alias("similarity"))


@query("a05_candidate_scores", f"""
    with {FACTS} select l_orderkey, l_linenumber, l_partkey, s as l_suppkey, round(score, 6) as score from scored""")
def a05(t):
    return scored(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("score", 6).alias("score"))


@query("a06_ranked_place", f"""
    with {FACTS}, b as (select *, row_number() over (partition by l_orderkey order by score desc, l_linenumber, l_partkey, s) rn
      from scored where score >= 0.58)
    select l_orderkey, s as l_suppkey, round(least(0.82, score), 6) as confidence from b where rn = 1 and s % 50 <> 9""")
def a06(t):
    s = scored(t).withColumn("score", F.round("score", 9))
    s = s.withColumn("pos", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    best = adr.rank_candidates(s, request="l_orderkey", score="score", pos="pos", lat="lat", lon="lon")
    return best.select("l_orderkey", "l_suppkey", F.round("confidence", 6).alias("confidence"))


EXACT = """
    ex as (select l_orderkey, arg_min(s, (l_linenumber, l_partkey, s)) s from c
      where (not has_house or s % 3 = k % 3) and k % 2 = s % 2 group by l_orderkey)"""


def exact(t):
    parsed = requests(t).withColumn("wanted", adr.address_parts(F.col("address")))
    c = candidates(t).join(parsed, F.col("l_orderkey") == F.col("o_orderkey"))
    c = c.withColumn("pos", F.struct("l_linenumber", "l_partkey", "l_suppkey")) \
        .withColumn("code", F.when(F.col("l_suppkey") % 2 == 0, "NY").otherwise("CA"))
    return adr.exact_match(c, request="l_orderkey", address="wanted", pos="pos", house="house_number",
                           zip_code="postcode", state="code")


@query("a07_exact_structure", f"with {FACTS}, {EXACT} select l_orderkey, s as l_suppkey from ex")
def a07(t):
    return exact(t).select("l_orderkey", "l_suppkey")


@query("a08_fallback_chain", f"""
    with {FACTS}, {EXACT}, b as (select *, row_number() over (partition by l_orderkey order by score desc, l_linenumber, l_partkey, s) rn
      from scored where score >= 0.58), r as (select l_orderkey, s from b where rn = 1 and s % 50 <> 9)
    select o_orderkey, case when o_orderkey % 4 = 0 and r.s is not null then r.s else coalesce(ex.s, r.s) end as l_suppkey,
      case when o_orderkey % 4 = 0 and r.s is not null then 'ranked' when ex.s is not null then 'exact'
           when r.s is not null then 'ranked' end as method
    from orders left join r on r.l_orderkey = o_orderkey left join ex on ex.l_orderkey = o_orderkey""")
def a08(t):
    s = scored(t).withColumn("score", F.round("score", 9)).withColumn(
        "pos", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    ranked = adr.rank_candidates(s, request="l_orderkey", score="score", pos="pos", lat="lat", lon="lon")
    req = requests(t).withColumnRenamed("o_orderkey", "l_orderkey")
    out = adr.resolve(req, key="l_orderkey", address="address", ranked=ranked.select("l_orderkey", "l_suppkey"),
                      exact=exact(t).select("l_orderkey", "l_suppkey"), place="l_suppkey")
    return out.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "method")


@query("a09_street_normal_form", """
    select p_partkey, lower(split_part(p_name, ' ', 1)) || ' ' || lower(split_part(p_name, ' ', 2)) || ' street 5th avenue cafe 12' as street
    from part""")
def a09(t):
    text = F.concat(F.upper("p_name"), F.lit(" St., Fifth  AVE; Café 12"))
    return t.part.select("p_partkey", adr.normal_address(text).alias("street"))


@query("a10_evidence_match", """
    select o_orderkey, case when o_orderkey % 11 = 0 then 'contradictory' when o_orderstatus = 'F' then 'possible'
      when o_orderkey % 3 <> 0 then case when o_custkey % 3 = o_orderkey % 4 then 'supported' else 'contradictory' end
      when o_orderstatus = 'P' then 'possible' else 'unknown' end as address_match from orders""")
def a10(t):
    o = F.col("o_orderkey")
    tags = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("operator-upload"))) \
        .when(F.col("o_orderstatus") == "P", F.array(F.lit("address-text-match"))) \
        .otherwise(F.array().cast("array<string>"))
    seen = F.when(o % 3 != 0, F.concat(F.lit("at "), (o % 4).cast("string"), F.lit(" Oak"))).otherwise("")
    want = F.concat((F.col("o_custkey") % 3).cast("string"), F.lit(" Oak Street"))
    return t.orders.select("o_orderkey", adr.measured_match(
        tags, F.when(o % 11 == 0, "unlikely").otherwise("likely"), want, seen).alias("address_match"))


@query("a11_query_variants", """
    select c_custkey, lower(c_mktsegment) || ' home' as first_variant,
      (2 + case when c_custkey % 3 = 0 then 1 else 0 end)::bigint as variants from customer""")
def a11(t):
    name = F.concat(F.lower("c_mktsegment"), F.lit("   home "))
    v = adr.query_variants(F.when(F.col("c_custkey") % 2 == 0, name), F.lit("  "), name, F.col("c_name"),
                           F.when(F.col("c_custkey") % 3 == 0, F.lit("extra")).otherwise(F.col("c_name")))
    return t.customer.select("c_custkey", F.get(v, 0).alias("first_variant"), F.size(v).cast("bigint").alias("variants"))


@query("a12_state_alias", """
    select c_custkey, c_custkey % 4 in (0, 1, 2) as same_state from customer""")
def a12(t):
    k = F.col("c_custkey") % 4
    code, name = pick(["NY", "CA", "UT", "UT"], k), pick(["New York", "CA", "ut", "Utah"], k)
    return t.customer.select("c_custkey", adr.state_matches(code, name).alias("same_state"))


@query("a13_title_case", """
    select n_nationkey, 'Main ' || list_aggregate(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '-') || ' NY' as title from nation""")
def a13(t):
    name = F.regexp_replace("n_name", " ", "-")
    return t.nation.select("n_nationkey", adr.title_case(F.concat(F.lit("MAIN "), name, F.lit(" NY"))).alias("title"))


@query("a14_country_gate", """
    select o_orderkey, o_orderkey % 4 in (0, 1) as domestic, (o_custkey % 90 + 1)::varchar as number from orders""")
def a14(t):
    text = pick(["12 Oak, 10001-2222", "12 Oak, Springfield, IL", "12 Oak, Paris, FR", "Nowhere 1234"], F.col("o_orderkey") % 4)
    number = F.concat(F.lit(" 00"), (F.col("o_custkey") % 90 + 1).cast("string"))
    return t.orders.select("o_orderkey", adr.country_gate(text).alias("domestic"), adr.normal_number(number).alias("number"))
