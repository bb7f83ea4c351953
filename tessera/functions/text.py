"""Text, key and URL functions as native columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of query parameters that only track a visitor. Others (ref, source, src) may name a posting and stay.
TRACKING = r"(?i)^(utm_.*|gh_src|fbclid|gclid|msclkid|mc_cid|mc_eid|igshid|_hsenc|_hsmi|trk|trackingid|wt_mc)$"
#: Where a posting's boilerplate begins.
BOILERPLATE = (
    r"(?i)\bequal[\s-]opportunity[\s-](employer|employment)\b",
    r"(?i)\bwithout regard to\b.{0,60}(race|colou?r|sex|age|national origin|disability|veteran)",
    r"(?i)\breasonable accommodations?\b",
    r"(?i)\bwe (celebrate|embrace|champion|welcome)\b.{0,40}\bdiversity\b",
    r"(?im)(?:^|\n)\s*(benefits|perks( and benefits)?|what we offer|total rewards)\s*[:\n]",
)
#: White space beyond ASCII.
BLANKS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: Aggregators of the lowest trust.
LOW_TRUST = ("adzuna", "jsearch", "indeed")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _replace_all(column: Column, pairs) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, *p), pairs, column)


def strip_html(html: Column) -> Column:
    """Tags to spaces, the common entities decoded (``&amp;`` first), white space collapsed and trimmed."""
    entities = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]
    plain = F.regexp_replace(html, "<[^>]*>", " ")
    plain = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), entities, plain)
    return F.trim(F.regexp_replace(plain, BLANKS + "+", " "))


def norm(text: Column) -> Column:
    """Lower case, without what stands in parentheses, other runs than a-z and 0-9 as one space, trimmed."""
    return F.trim(_replace_all(F.lower(text), [(r"\([^)]*\)", " "), ("[^a-z0-9]+", " ")]))


def dedupe_key(source: Column, external: Column) -> Column:
    return F.sha1(F.concat(source, F.lit(":"), external.cast("string")))


def content_key(title: Column, company: Column) -> Column:
    return F.sha1(F.concat(norm(title), F.lit("|"), norm(company)))


def host_of(url: Column) -> Column:
    """Lower-cased host without user and port; null where the URL isn't http."""
    found = F.regexp_extract(url, r"^[hH][tT][tT][pP][sS]?://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(found != "", F.lower(found))


def host_in(host: Column, names) -> Column:
    """Whether the host is one of ``names`` or below one."""
    return F.coalesce(reduce(lambda a, n: a | (host == n) | host.endswith("." + n), names, F.lit(False)), F.lit(False))


def _form_encoded(part: Column) -> Column:
    return F.coalesce(F.url_encode(F.try_url_decode(part)), part)


def canonical_url(url: Column) -> Column:
    """Host lower-cased, no fragment, no tracking parameters, the others sorted by name, no closing slash where no query follows.

    Names are compared without case, equal ones keep their order. What is no
    http URL comes back as it is.
    """
    bare = F.regexp_replace(F.trim(url), "(?s)#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([a-zA-Z]+://)", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[a-zA-Z]+://([^/?]*)", 1)), F.when(scheme == "http://", ":80$").otherwise(":443$"), F.lit(""))
    path = F.regexp_extract(bare, r"^[a-zA-Z]+://[^/?]*(/[^?]*)", 1)
    query = F.regexp_extract(bare, r"(?s)\?(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    named = F.transform(pairs, lambda p, i: F.struct(F.lower(F.substring_index(p, "=", 1)).alias("order"), i.alias("place"), F.substring_index(p, "=", 1).alias("name"), F.when(p.contains("="), F.regexp_replace(p, "(?s)^[^=]*=", "")).otherwise("").alias("value")))
    kept = F.array_sort(F.filter(named, lambda p: ~F.coalesce(F.try_url_decode(p["name"]), p["name"]).rlike(TRACKING)))
    joined = F.array_join(F.transform(kept, lambda p: F.concat(_form_encoded(p["name"]), F.lit("="), _form_encoded(p["value"]))), "&")

    def whole(q: Column) -> Column:
        short = F.when(path.isin("", "/"), "/").when(q == "", F.regexp_replace(path, "/$", "")).otherwise(path)
        return F.concat(scheme, host, short, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))

    return F.when(F.trim(url).rlike("^[hH][tT][tT][pP][sS]?://[^/?#]"), let(joined, whole)).otherwise(url)


def is_direct(source: Column) -> Column:
    return source.contains(":")


def source_trust(source: Column) -> Column:
    return F.when(is_direct(source), 2).when(source.isin(*LOW_TRUST), 0).otherwise(1)


def count_hits(text: Column, needles) -> Column:
    """The needles that stand anywhere in the lower-cased ``text``, in their own order."""
    if not needles:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*(F.when(F.contains(text, F.lit(n.lower())), F.lit(n)) for n in needles)))


def word_hits(text: Column, needles) -> Column:
    """The needles that no letter a-z or à-ü touches in the lower-cased ``text``."""
    if not needles:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?:^|[^a-zà-ü]){_quoted(n.lower().strip())}(?:$|[^a-zà-ü])"), F.lit(n)) for n in needles)))


def _quoted(needle: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in needle)


def trim_boilerplate(text: Column, markers=BOILERPLATE, floor: int = 300, start: int = 600) -> Column:
    """Cut before the earliest marker, if at least ``floor`` characters and 30 % stay; closing white space goes either way.

    Of each marker, a regular expression, the first match counts, and only if
    it begins at ``start`` or later: before that it is the posting's own text.
    """
    def cut(first: Column) -> Column:
        at = F.least(F.length(text), F.coalesce(F.array_min(F.filter(first, lambda i: i >= start)), F.length(text)))
        keep = F.when((at >= floor) & (at >= 0.3 * F.length(text)), F.substring(text, F.lit(1), at)).otherwise(text)
        return F.regexp_replace(keep, BLANKS + r"+\z", "")

    return let(F.array(*(F.regexp_instr(text, F.lit(m)) - 1 for m in markers)), cut)


def safe_slice(text: Column, most: int) -> Column:
    """The first ``most`` characters; a character is never cut in two."""
    return F.substring(text, 1, most)


def model_json(raw: Column, schema: str) -> Column:
    """The outermost braces of a model's answer, parsed; null where there are none."""
    found = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.when(found != "", F.from_json(found, schema))


def hash_half(key: Column, modulus: int = 997) -> Column:
    """tune or confirm, by the parity of the sum of character codes modulo ``modulus``."""
    total = F.aggregate(F.transform(F.split(key.cast("string"), ""), lambda c: F.ascii(c)), F.lit(0), lambda a, c: a + c)
    return F.when(total % modulus % 2 == 0, "tune").otherwise("confirm")


def div_content(html: Column, name: str) -> Column:
    """What stands in the first ``div`` whose class holds ``name``, with the divs inside; null where there is none or it never closes.

    Tags of divs are numbered by how deep they leave the text; the first that
    is back at the start ends it.
    """
    opened = F.regexp_extract(html, rf'(?i)<div[^>]*class="[^"]*{name}[^"]*"[^>]*>', 0)
    rest = F.substring(html, F.position(opened, html) + F.length(opened), F.length(html))

    def body(after: Column) -> Column:
        pieces = F.split(after, "(?i)(?=</?div)")  # each but the first begins with a tag
        step = lambda p: F.when(F.lower(p).startswith("</div"), -1).when(F.lower(p).startswith("<div"), 1).otherwise(0)
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))

        def walk(a: Column, p: Column) -> Column:
            depth = a["depth"] + step(p)
            done = a["done"] | (depth == 0)
            return F.struct(depth.alias("depth"), F.when(done, a["size"]).otherwise(a["size"] + F.length(p)).alias("size"), done.alias("done"))

        end = F.aggregate(pieces, start, walk)
        return F.when(end["done"], F.substring(after, F.lit(1), end["size"]))

    return F.when(opened != "", let(rest, body))
