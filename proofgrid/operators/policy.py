"""URL, rights and source policy as column expressions (no shuffle, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.functions.text import let, squeeze
from proofgrid.operators.address import address_text_match

# Source rules in order; the first matching rule decides.
# (hosts, provider, rights, cache policy, redistributable, hard blocked); provider None = the host.
SOURCE_RULES = [
    (["youtube.com", "youtu.be"], "YouTube", "link_only", "prohibited", False, True),
    (["google.com", "googleusercontent.com", "gstatic.com"], "Google", "link_only", "prohibited", False, True),
    (["facebook.com", "instagram.com", "tiktok.com", "x.com", "twitter.com"],
     None, "restricted", "metadata_only", False, False),
    (["zillow.com"], "Zillow", "link_only", "metadata_only", False, True),
    (["redfin.com"], "Redfin", "link_only", "metadata_only", False, True),
    (["openstreetmap.org", "openstreetmap.fr"], "OpenStreetMap", "open_license", "local_allowed", True, False),
    (["loc.gov", "archives.gov", "usgs.gov", "nasa.gov"], None, "public_domain", "local_allowed", True, False),
]
DEFAULT_RULE = (None, "research_unknown", "metadata_only", False, False)
HARD_BLOCK_HOSTS = ["accounts.google.com", "login.microsoftonline.com", "login.live.com", "facebook.com",
                    "www.facebook.com", "twitter.com", "x.com", "instagram.com", "www.instagram.com"]
REDIRECT_HOST = "bing.com"
SEARCH_OWNERS = ["bing.com", "microsoft.com"]
SEARCH_HOSTS = ["bing.com", "www.bing.com", "duckduckgo.com", "www.duckduckgo.com", "search.brave.com"]
LISTING_HOSTS = ["zillow.com", "redfin.com"]
OPEN_LICENCES = ["pdm", "cc0", "by", "by-sa"]
OPEN_RIGHTS = ["open_license", "public_domain"]
ENTITIES = [("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#0*39;|&apos;", "'")]
MIN_IMAGE_WIDTH, MIN_IMAGE_HEIGHT = 320, 240


def host_of(url: Column) -> Column:
    """Lower-case host; NULL for a URL that does not parse."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


def host_suffixes(host: Column) -> Column:
    """All dotted suffixes of a host: a.b.c -> [a.b.c, b.c, c]."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def host_matches(host: Column, hosts: list[str]) -> Column:
    """The host itself or any subdomain of a listed host."""
    return F.coalesce(host.rlike(r"(^|\.)(" + "|".join(h.replace(".", r"\.") for h in hosts) + ")$"), F.lit(False))


def classify_source(url: Column, rules=SOURCE_RULES) -> Column:
    """Provider, rights and cache policy of a URL; first matching rule wins."""
    def decide(host):
        def decision(provider, rights, cache, redistributable, blocked):
            return F.struct(
                (F.lit(provider) if provider else host).alias("provider"), F.lit(rights).alias("rights"),
                F.lit(cache).alias("cache_policy"), F.lit(redistributable).alias("redistributable"),
                F.lit(blocked).alias("hard_blocked"))

        chain = None
        for hosts, *rest in rules:
            cond, value = host_matches(host, hosts), decision(*rest)
            chain = F.when(cond, value) if chain is None else chain.when(cond, value)
        return F.when(host.isNotNull(), chain.otherwise(decision(*DEFAULT_RULE)))

    return let(bare_host(url), decide)


def classify_with_table(df: DataFrame, rules: DataFrame, *, url: str, key: str) -> DataFrame:
    """U01 for a rule table of any length: (suffix, priority, ...) joined on exploded suffixes.

    The broadcast decision is left to the optimizer's size threshold; the row
    count per URL is bounded by the labels of one host name.
    """
    exploded = df.select(key, F.explode(host_suffixes(bare_host(F.col(url)))).alias("suffix"))
    facts = [c for c in rules.columns if c not in ("suffix", "priority")]
    best = exploded.join(rules, "suffix").groupBy(key).agg(
        F.min_by(F.struct(*facts), F.col("priority")).alias("rule"))
    return df.join(best, key, "left")


def is_http(url: Column) -> Column:
    """Parses and is http or https."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False)) \
        & host_of(url).isNotNull()


def unwrap_redirect(url: Column) -> Column:
    """Target of a search redirect, or the URL itself when it is none."""
    target = F.try_parse_url(url, F.lit("QUERY"), F.lit("u"))
    encoded = F.translate(F.when(target.startswith("a1"), F.substr(target, F.lit(3))).otherwise(target), "-_", "+/")
    padded = F.rpad(encoded, (F.ceil(F.length(encoded) / 4) * 4).cast("int"), F.lit("="))
    decoded = F.try_to_binary(padded, F.lit("base64")).cast("string")
    hit = F.coalesce(host_of(url).endswith(REDIRECT_HOST), F.lit(False)) & is_http(decoded)
    return F.when(hit, decoded).otherwise(url)


def is_external(url: Column) -> Column:
    """http(s) and the host does not end with a search owner (look-alikes included)."""
    host = host_of(url)
    owned = host.endswith(SEARCH_OWNERS[0]) | host.endswith(SEARCH_OWNERS[1])
    return is_http(url) & ~F.coalesce(owned, F.lit(False))


def is_listing(url: Column) -> Column:
    """A listing site or a true subdomain of one."""
    return host_matches(bare_host(url), LISTING_HOSTS)


def allowed_navigation(url: Column) -> Column:
    """http(s), no hard-blocked host, and not hard-blocked by policy."""
    def open_host(host):
        blocked = host.isin(HARD_BLOCK_HOSTS) | F.regexp_replace(host, r"^www\.", "").isin(HARD_BLOCK_HOSTS)
        banned = [h for hosts, *rest in SOURCE_RULES if rest[-1] for h in hosts]
        return ~blocked & ~host_matches(host, banned)

    return is_http(url) & F.coalesce(let(host_of(url), open_host), F.lit(False))


OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
QUAD = rf"{OCTET}(?:\.{OCTET}){{3}}"


def _ipv6_pattern() -> str:
    """All ways to write an IPv6 address, with at most one run of groups left out."""
    h = "[0-9a-f]{1,4}"
    forms = [f"(?:{h}:){{7}}{h}", f"(?:{h}:){{1,7}}:", f":(?::{h}){{1,7}}", "::", f"(?:{h}:){{6}}{QUAD}"]
    forms += [f"(?:{h}:){{1,{n}}}(?::{h}){{1,{7 - n}}}" for n in range(1, 7)]
    forms += [f"::(?:{h}:){{0,5}}{QUAD}", *[f"(?:{h}:){{{n}}}:(?:{h}:){{0,{5 - n}}}{QUAD}" for n in range(1, 6)]]
    return f"^(?:{'|'.join(forms)})$"


def is_private_ip(address: Column) -> Column:
    """Private or reserved address; anything that is no IP counts as private.

    Behind ``::ffff:`` only a dotted quad can be public.
    """
    a = F.lower(address)
    mapped = F.regexp_replace(a, "^::ffff:(?=[0-9.]+$)", "")
    is_v4 = mapped.rlike(f"^{QUAD}$")
    is_v6 = a.rlike(_ipv6_pattern()) & ~a.startswith("::ffff:")
    o = F.split(mapped, r"\.")
    first, second = F.try_element_at(o, F.lit(1)).try_cast("int"), F.try_element_at(o, F.lit(2)).try_cast("int")
    v4 = (
        first.isin(0, 10, 127) | (first >= 224) | ((first == 100) & second.between(64, 127))
        | ((first == 169) & (second == 254)) | ((first == 172) & second.between(16, 31))
        | ((first == 192) & (second == 168))
    )
    v6 = a.isin("::1", "::") | a.rlike("^(fc|fd|fe8|fe9|fea|feb)")
    return F.when(is_v4, v4).when(is_v6, v6).otherwise(F.lit(True))


def clean_metadata(text: Column, max_chars: int = 500) -> Column:
    """Strip tags and five entities, squeeze space; the stored field holds ``max_chars``."""
    out = F.regexp_replace(text, "<[^>]+>", " ")
    for pattern, plain in ENTITIES:
        out = F.regexp_replace(out, pattern, plain)
    out = squeeze(out)
    return F.when(out != "", F.substring(out, 1, max_chars))


def clean_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "(?i)^File:", ""), "_", " "))


def search_query(text: Column) -> Column:
    """Keep letters, digits and single spaces."""
    return squeeze(F.regexp_replace(text, r"[^\p{L}\p{N}\s\p{Z}]", " "))


def licence_code(code: Column, label: Column) -> Column:
    """Open licence code or NULL; restricted variants are rejected first."""
    text = F.lower(F.concat_ws(" ", F.coalesce(code, F.lit("")), F.coalesce(label, code, F.lit(""))))
    rejected = text.contains("noncommercial") | text.contains("no derivatives") \
        | text.rlike(r"\bcc[- ]?by[- ]?(?:nc|nd)\b")
    public = text.contains("public domain") | text.contains("public-domain") | text.contains("cc0") \
        | text.contains("pd-old")
    return (
        F.when(rejected, None)
        .when(public & text.contains("cc0"), "cc0").when(public, "pdm")
        .when(text.contains("cc by-sa") | text.contains("cc-by-sa"), "by-sa")
        .when(text.contains("cc by") | text.contains("cc-by"), "by")
    )


def https_url(url: Column) -> Column:
    return F.regexp_replace(url, "^http:", "https:")


def licence_allowed(code: Column) -> Column:
    """The defensive second check."""
    return F.coalesce(F.lower(F.trim(code)).isin(OPEN_LICENCES), F.lit(False))


def import_eligible(cache_policy: Column, rights: Column, download_url: Column,
                    hard_blocked: Column | None = None) -> Column:
    """Locally cacheable, openly licensed, downloadable and not blocked."""
    ok = (cache_policy == "local_allowed") & rights.isin(OPEN_RIGHTS) & (F.coalesce(download_url, F.lit("")) != "")
    return F.coalesce(ok if hard_blocked is None else ok & ~hard_blocked, F.lit(False))


def link_kind(title: Column, description: Column) -> Column:
    """Kind of a web result by its words."""
    text = F.lower(F.concat_ws(" ", title, F.coalesce(description, F.lit(""))))
    return (F.when(text.contains("floor plan") | text.contains("blueprint"), "blueprint")
            .when(text.contains("record") | text.contains("assessor"), "record").otherwise("web_page"))


def page_image_admitted(page_url: Column, image_url: Column, width: Column, height: Column, address: Column,
                        title: Column, text: Column) -> Column:
    """An image of an address-matched page that may be collected; whole page text is matched."""
    return (
        allowed_navigation(page_url) & ~host_of(page_url).isin(SEARCH_HOSTS)
        & F.coalesce(image_url.rlike("(?i)^https?://"), F.lit(False))
        & (F.coalesce(width, F.lit(0)) >= MIN_IMAGE_WIDTH) & (F.coalesce(height, F.lit(0)) >= MIN_IMAGE_HEIGHT)
        & ~F.coalesce(classify_source(image_url)["hard_blocked"], F.lit(False))
        & address_text_match(address, F.concat_ws(" ", title, page_url, text))
    )


def normal_url(url: Column) -> Column:
    """URL with lower-case scheme and host, no default port, '/' for an empty path."""
    def part(name):
        return F.try_parse_url(url, F.lit(name))

    scheme = F.lower(part("PROTOCOL"))
    authority = F.lower(part("AUTHORITY"))
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")) \
        .when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    path = F.when(F.coalesce(part("PATH"), F.lit("")) == "", "/").otherwise(part("PATH"))
    return F.when(host_of(url).isNotNull(), F.concat(
        scheme, F.lit("://"), authority, path,
        F.coalesce(F.concat(F.lit("?"), part("QUERY")), F.lit("")),
        F.coalesce(F.concat(F.lit("#"), part("REF")), F.lit(""))))


def same_url(left: Column, right: Column) -> Column:
    """Equal after normalising; a URL that does not parse equals nothing."""
    return F.coalesce(normal_url(left) == normal_url(right), F.lit(False))


def exportable(df: DataFrame, *, redistributable: str) -> DataFrame:
    """Rows whose bytes may leave; everything else is a link only."""
    return df.filter(F.coalesce(F.col(redistributable), F.lit(False)))
