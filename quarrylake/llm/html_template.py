"""HTML extraction: equivalence-class template deduction.

A page is a stream of tokens: tags, told apart by their path, and the texts of blocks by path and words. Over all pages
of a host each token has an occurrence vector (how often on which page), kept as sums of hashes of (page, count), which
add up in parallel. Tokens of equal vectors are a class. A class nests by its tags: each of its texts belongs to the
deepest tag of the class above it, the text's anchor. An anchor is valid if its texts come in the same order after each
of its tags, on every page; valid anchors and their texts, nested by path, are the template. What it leaves open are
slots; the host's main slot is the deepest tag of the page's own class that holds most of its text (main_slots()), found
from occurrences alone. Each page's result is the text in that slot, without the template's texts and without parts in it
that are named as menus, headers, footers, notices, adverts, forms or comments, unless these hold the page's only article
or main element or most of the varying text. A page without the container, or a host of fewer than MIN_PAGES pages, is
judged by its own tree and these names.

Defined cases: null html is an empty page with an empty text; a page without a url belongs to the host ""; repeated
rows are extracted alike and count as one page for the support of a class; unclosed elements end where HTML ends them;
unfinished tags at the end are dropped; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import batch_of, read_table, scratch

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg object select option button annotation".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mspace mpadded mfenced semantics".split())
CLOSES_P = frozenset("address article aside blockquote body details div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("ul ol dl table article main section body".split())
MAIN = ("article", "main")
_HEADING = re.compile(r"/(?:h[1-6]|dt|th|caption|summary)(?:\.[^/]*)?$")
#: A longer step of a path is the tag and a hash; elements of more steps share their container's path, but for article and main.
STEP, DEPTH = 40, 128
#: Elements that may be the main container where no article or main is.
BOXES = ("body", "div", "section", "td", "center")
#: Elements that are a part of the text of what they stand in.
LINES = ("p", "h[1-6]", "blockquote", "pre", "figure", "figcaption", "li", "dt", "dd", "address", "summary")
#: A text of fewer pages is not taken as a template's.
MIN_PAGES = 4
#: Elements, and words of class, id and role, that are not the article.
OUT_TAGS = frozenset("head nav header footer aside form menu dialog fieldset figcaption".split()) - {"figcaption"}
OUT_WORDS = re.compile(r"^(ads?|advert\w*|banners?|sponsor\w*|promo\w*|cookies?|notices?|consent|popups?|modals?|newsletters?|subscribe|subscription|share|sharing|social|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|comments?|commentlist|respond|replies|disqus|related|recommend\w*|widgets?|toolbar|pagination|pager|complementary|contentinfo|alert|search)$")


#: Words that only make a name of OUT_WORDS longer: site-footer, comment-list.
BOX_WORDS = frozenset("site list area box bar block button buttons link links posts slot section form inner".split())
#: Elements that stay out whatever they hold, unless all of a page's article and main elements are in them.
NEVER = frozenset("head nav header footer menu dialog aside".split())


class Element:
    """path names it, any says whether it or an element above it is out."""

    __slots__ = ("tag", "path", "any")

    def __init__(self, tag: str, path: str, any_: bool):
        self.tag, self.path, self.any = tag, path, any_


def _named(tag: str, attrs: str, by_name: bool = True) -> tuple[str, bool]:
    """The element's step in a path, and whether it is named as no part of an article: by a whole class, id or role, not by a part of one."""
    words, names = [], []
    if attrs and ("=" in attrs):
        for m in _ATTR.finditer(attrs):
            for name in (m[2] or m[3] or m[4] or "").lower().split():
                names.append([w for w in re.split(r"[^a-z0-9]+", name) if w])
                words += [re.sub(r"\d+", "N", w) for w in names[-1]]
    out = by_name and (tag in OUT_TAGS or tag not in ("html", "body", *MAIN) and any(_out_name(x) for x in names))
    step = f"{tag}.{'.'.join(sorted(set(words)))}" if words else tag
    return step if len(step) <= STEP else f"{tag[:STEP]}.{xxhash.xxh3_64_hexdigest(step.encode('utf-8', 'surrogatepass'))}", out


def _out_name(parts: list[str]) -> bool:
    hits = [bool(OUT_WORDS.match(w)) for w in parts]
    return any(hits) and all(h or w in BOX_WORDS or w.isdigit() for h, w in zip(hits, parts))


def blocks(html: str, spared: frozenset[str] | set[str] = frozenset(), by_name: bool = True) -> Iterator[tuple[str, bool, str]]:
    """(path, named out, text) of each block of text, and (path, named out, "") as each element opens.

    The step of an element that is named out begins with "!"; elements of the paths in spared are not out. Whether text
    is out is said of each run of it, so an inline element takes no more than its own words out of a block. A heading
    in the header of an article or main element is not out. by_name False: no name puts anything out.
    """
    stack: list[Element] = []
    held: list[tuple[str, str, bool]] = []
    end, n = 0, len(html)

    def hold(text: str) -> None:
        top = stack[-1] if stack else None
        held.append((text, top.path if top else "", top.any if top else False))

    def flush() -> Iterator[tuple[str, bool, str]]:
        for out in (False, True):
            runs = [(t, p) for t, p, o in held if o == out]
            text = " ".join(unescape("".join(t for t, _ in runs)).split())
            if text:
                yield (next(p for t, p in runs if not t.isspace()), out, text)
        held.clear()

    while end < n:
        m = _TOKEN.search(html, end)
        if m is None:
            hold(html[end:])
            break
        if m.start() > end:
            hold(html[end : m.start()])
        end = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = m[1] or m[4], m[3] or m[6] or ""
        if tag not in INLINE:
            yield from flush()
        if closing:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if at is not None:
                del stack[at:]
            continue
        if tag in VOID:
            continue
        if tag in RAW and not attrs.rstrip().endswith("/"):
            close = re.compile(f"</{tag}\\b[^>]*>", re.I).search(html, end)
            end = close.end() if close else n
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in SAME:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in SAME[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES:
                    break
        step, out = _named(tag, attrs, by_name)
        above, over = (stack[-1].path, stack[-1].any) if stack else ("", False)
        if tag in INLINE:
            path = f"{above}/!{step}" if out else above
        else:
            # below DEPTH a block has the path of the container there: nothing is lost, and paths stay bounded
            path = f"{above}/{'!' * out}{step}" if tag in MAIN or out or above.count("/") < DEPTH else above
        if over and _TITLE.match(tag) and _own_header(stack):
            over = False
        stack.append(Element(tag, path, over or out and path not in spared))
        if tag not in INLINE:
            yield (path, stack[-1].any, "")
    yield from flush()


_TITLE = re.compile("h[1-6]$")


def _own_header(stack: list[Element]) -> bool:
    """Whether all that is out here is one header of an article or main element."""
    at = next(i for i, e in enumerate(stack) if e.any)
    return stack[at].tag == "header" and at > 0 and stack[at - 1].tag in MAIN and not any("!" in e.path[len(stack[at].path) :] for e in stack[at + 1 :])


def _outs(path: str) -> list[str]:
    """The paths of the named out elements of a path."""
    return [path[: m.end()] for m in re.finditer(r"/![^/]*", path)]


def page_blocks(html: str, spared: frozenset[str] | set[str] = frozenset(), by_name: bool = True) -> list[tuple[str, bool, str]]:
    """As blocks(). What is named out is not where the page's article and main elements, or all of its text, are only there."""
    all_ = list(blocks(html, spared, by_name))
    if not by_name:
        return all_
    mains = [p for p, out, t in all_ if not t and _is_main(p)]
    if mains:
        if not any(_is_main(p) and not out for p, out, _ in all_):
            above = {x for p in mains for x in _outs(re.match(r"(.*?/(?:article|main)(?:\.[^/]*)?)(?:/|$)", p)[1])}
            return list(blocks(html, above | set(spared)))
    else:
        while not any(t and not out for _, out, t in all_):
            held: dict[str, int] = {}
            for p, _, t in all_:
                for x in _outs(p) if t else ():
                    held[x] = held.get(x, 0) + len(t)
            most = {x for x, n in held.items() if x not in spared and 2 * n > sum(len(t) for _, _, t in all_) and _tag(x) not in NEVER}
            if not most:
                break
            spared = most | set(spared)
            all_ = list(blocks(html, spared))
    return all_


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _hash(*what: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(what)) - (1 << 63)


#: Bits that a page sets one of in a token's mask: their number is its support, the same for repeated rows.
MASKS = 4
_SUMS = ("pages", "low", "high", "chars", "times")
_STATS = pa.schema([("host", pa.string()), ("path", pa.string()), ("out", pa.bool_()), ("token", pa.int64()), *((k, pa.int64()) for k in _SUMS), *((f"mask{k}", pa.int64()) for k in range(MASKS))])
_STATS_DDL = "host string, path string, out boolean, token long, " + ", ".join(f"{k} long" for k in _SUMS) + "".join(f", mask{k} long" for k in range(MASKS))


def _occurrences(batches: Iterator[pa.RecordBatch], by_name: bool = True) -> Iterator[pa.RecordBatch]:
    """Per batch: each host's tokens with their pages, vector and characters, already summed. Token 0 is a path's own tag."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            sums: dict[tuple, list[int]] = {}
            for page, url, html in zip(*(part.column(k).to_pylist() for k in range(3))):
                seen: dict[tuple, list[int]] = {}
                for path, out, text in page_blocks(html or "", by_name=by_name):
                    x = seen.setdefault((path, out, _hash(path, text) if text else 0), [0, 0])
                    x[0] += 1
                    x[1] += len(text)
                host, bit = host_of(url), _hash(str(page), url or "", html or "") % (64 * MASKS)
                for (path, out, token), (n, chars) in seen.items():
                    s = sums.setdefault((host, path, out, token), [0] * (len(_SUMS) + MASKS))
                    v = _hash(str(page), url or "", str(n)) + (1 << 63)
                    for k, x in enumerate((1, v & 0x7FFFFFFF, v >> 33, chars, n)):
                        s[k] += x
                    s[len(_SUMS) + bit // 64] |= 1 << bit % 64
            if sums:
                signed = lambda x: x - (x >> 63 << 64)
                yield batch_of(_STATS, zip(*((*k, *v[: len(_SUMS)], *map(signed, v[len(_SUMS) :])) for k, v in sums.items())))


def _above(path):
    """The paths of the containers of a path, itself among them."""
    steps = F.split(path, "/")
    return F.array_distinct(F.transform(F.sequence(F.lit(2), F.greatest(F.size(steps), F.lit(2))), lambda k: F.array_join(F.slice(steps, 1, k), "/")))


def _summed(tokens: DataFrame, by: list[str]) -> DataFrame:
    support = sum((F.bit_count(F.bit_or(f"mask{k}")) for k in range(MASKS)), F.lit(0))
    return tokens.groupBy(*by).agg(*[F.sum(k).alias(k) for k in _SUMS], support.alias("support"), *[F.bit_or(f"mask{k}").alias(f"mask{k}") for k in range(MASKS)])


def templates(pages: DataFrame, by_name: bool = True) -> DataFrame:
    """host -> its main container's path and the template's texts.

    The main container is the main slot of main_slots() where there is one; what follows is for the other hosts. A text is steady if its class has a tag above it, of whose text a quarter or more is not of the class. Steady texts
    of MIN_PAGES pages or more are the template's if their anchors are valid. The main container is an article or main
    element where the varying text is in one; else the deepest element of BOXES that is once on its pages and keeps
    all of the varying text, since what is outside of it is lost.
    """
    keyed = pages.select(F.col("page_id").cast("string").alias("page"), "url", "html")
    tokens = scratch(_summed(keyed.mapInArrow(partial(_occurrences, by_name=by_name), _STATS_DDL), ["host", "path", "out", "token"]), "html-tokens")
    vector = ["host", "pages", "low", "high"]
    tags = _summed(tokens.where("token = 0"), ["host", "path"]).withColumnRenamed("path", "container").drop("chars", *[f"mask{k}" for k in range(MASKS)])
    texts = tokens.where("token <> 0").drop("times", *[f"mask{k}" for k in range(MASKS)])
    inside = F.expr("path = container or startswith(path, container || '/')")
    # the classes: tokens of equal vectors, here a text with each tag of its class above it
    pairs = texts.where("pages > 1").join(tags.select(*vector, "container"), vector).where(inside)
    pairs = scratch(pairs.select("host", "container", "path", "out", "token", "support", "chars"), "html-pairs")
    by_path = scratch(texts.groupBy("host", "path", "out").agg(F.sum("chars").alias("chars")), "html-paths")
    lone = texts.where("support = 1").groupBy("host", "path").agg(F.sum("chars").alias("chars"))
    slots = scratch(main_slots(by_path, lone, tags), "html-slots")
    spared = _spared(by_path, pairs, tags)
    open_ = F.expr("not out or spared is not null and forall(above, x -> not startswith(element_at(split(x, '/'), -1), '!') or array_contains(spared, x))")
    by_path, pairs = (x.join(spared, "host", "left").withColumn("above", _above("path")).where(open_).drop("above", "spared") for x in (by_path, pairs))
    by_path = by_path.groupBy("host", "path").agg(F.sum("chars").alias("chars"))
    # each container above a path holds its text; paths are few a host, whatever its pages
    whole = by_path.withColumn("container", F.explode(_above("path"))).groupBy("host", "container").agg(F.sum("chars").alias("whole"))
    varied = pairs.groupBy("host", "container").agg(F.sum("chars").alias("same")).join(whole, ["host", "container"]).where("same * 4 <= whole * 3").select("host", "container")
    kept = pairs.join(varied, ["host", "container"], "left_semi")
    steady = kept.groupBy("host", "path", "token", "support").agg(F.max("chars").alias("chars"), F.max_by("container", F.size(F.split("container", "/"))).alias("anchor"))
    steady = scratch(steady.withColumn("anchor", F.xxhash64("anchor")), "html-steady")
    found = steady.where(F.col("support") >= MIN_PAGES).select("host", "token", "anchor")
    bad = scratch(_disordered(pages, found, spared, by_name), "html-disordered")
    steady = steady.join(bad, ["host", "anchor"], "left_anti")
    fixed = found.join(bad, ["host", "anchor"], "left_anti").groupBy("host").agg(F.sort_array(F.collect_set("token")).alias("fixed"))
    left = by_path.unionByName(steady.select("host", "path", (-F.col("chars")).alias("chars"))).groupBy("host", "path").agg(F.sum("chars").alias("varying"))
    held = left.withColumn("container", F.explode(_above("path"))).groupBy("host", "container").agg(F.sum("varying").alias("varying"))
    kind, depth = _kind(F.col("container")), F.size(F.split("container", "/"))
    all_ = held.groupBy("host").agg(F.max("varying").alias("whole"))
    semantic = F.when(kind.isin(*MAIN), 1).otherwise(0)
    box = kind.isin(*BOXES) & (F.col("times") <= F.col("pages")) & (F.col("varying") == F.col("whole"))
    ranked = held.join(all_, "host").join(tags.select("host", "container", "pages", "times"), ["host", "container"]).where("varying > 0 and varying * 2 >= whole").where((semantic == 1) | box)
    best = ranked.groupBy("host").agg(F.max(F.struct(semantic.alias("semantic"), F.when(semantic == 1, -depth).otherwise(depth).alias("depth"), F.col("varying"), F.col("container"))).alias("best"))
    out = best.join(fixed, "host", "full").join(spared, "host", "full").join(slots, "host", "full")
    over = F.filter(_above(F.col("slot")), lambda x: F.element_at(F.split(x, "/"), -1).startswith("!"))
    all_spared = F.when(F.col("slot").isNotNull(), F.array_union(F.coalesce("spared", F.array().cast("array<string>")), over)).otherwise(F.col("spared"))
    return out.select("host", F.coalesce("slot", "best.container").alias("container"), (F.col("slot").isNotNull() | (F.col("best.semantic") == 1)).alias("sure"), "fixed", all_spared.alias("spared"))


def _kind(path: Column) -> Column:
    """The tag of a path's last step."""
    return F.ltrim(F.substring_index(F.element_at(F.split(path, "/"), -1), ".", 1), F.lit("!"))


def _own_box(path: Column) -> Column:
    """The container that a text belongs to: its path without the elements of LINES at its end."""
    return F.regexp_replace(path, rf"(/!?({'|'.join(LINES)})(\.[^/]*)?)+$", "")


def main_slots(by_path: DataFrame, lone: DataFrame, tags: DataFrame) -> DataFrame:
    """host -> the slot that holds its articles, told from the template alone: no name of a class, id or role is looked at.

    Tags that are once on every page of a host have the page's own occurrence vector: they are the class that the
    template is made of, and what varies lies in its slots. The main slot is the deepest of these tags that holds more
    than half of the host's text, or the outermost article or main element of the class around it, or, on hosts without
    such elements, the outermost tag of the class around it that has texts of single pages (lone) of its own, in no other box:
    so nothing that varies is lost beside the slot but what other boxes hold. Hosts of fewer than
    MIN_PAGES pages have none, nor have those with article or main elements only elsewhere.
    """
    whole = tags.groupBy("host").agg(F.max("pages").alias("most"), F.max("support").alias("n"))
    own = tags.join(whole, "host").where((F.col("pages") == F.col("most")) & (F.col("times") == F.col("pages")) & (F.col("n") >= MIN_PAGES)).select("host", "container")
    held = by_path.withColumn("container", F.explode(_above("path"))).groupBy("host", "container").agg(F.sum("chars").alias("held"))
    total = by_path.groupBy("host").agg(F.sum("chars").alias("total"))
    half = held.join(total, "host").where("held * 2 > total").join(own, ["host", "container"])
    deep = half.groupBy("host").agg(F.max(F.struct(F.size(F.split("container", "/")), F.col("container"))).alias("x")).select("host", F.col("x.container").alias("deepest"))
    mains = tags.select("host", "container").where(_kind(F.col("container")).isin(*MAIN)).join(own.withColumn("own", F.lit(True)), ["host", "container"], "left").join(deep, "host")
    around = F.expr("own and (deepest = container or startswith(deepest, container || '/'))")
    outer = mains.groupBy("host").agg(F.min_by(F.when(around, F.col("container")), F.when(around, F.length("container"))).alias("outer"), F.lit(True).alias("mains"))
    loose = lone.select("host", _own_box(F.col("path")).alias("container")).distinct()
    widest = own.join(loose, ["host", "container"]).join(deep, "host").where("deepest = container or startswith(deepest, container || '/')").groupBy("host").agg(F.min_by("container", F.length("container")).alias("widest"))
    slot = F.when(F.col("mains"), F.col("outer")).otherwise(F.coalesce("widest", "deepest"))
    return deep.join(outer, "host", "left").join(widest, "host", "left").select("host", slot.alias("slot")).where("slot is not null")


_ORDERS = pa.schema([("host", pa.string()), ("anchor", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def orders(html: str, anchor_of: dict[int, int], spared: frozenset[str] | set[str] = frozenset(), by_name: bool = True) -> dict[int, set[int]]:
    """Anchor -> hashes of the sequences of its texts, one after each of its tags; anchors are hashed paths."""
    anchors, now, out = set(anchor_of.values()), {}, {}
    known: dict[str, int] = {}
    for path, _, text in page_blocks(html, spared, by_name):
        if text:
            token = _hash(path, text)
            if token in anchor_of:
                now.setdefault(anchor_of[token], []).append(token)
            continue
        a = known.get(path)
        if a is None:
            a = known[path] = _spark_hash(path)
        if a in anchors:
            if a in now:
                out.setdefault(a, set()).add(_hash(*map(str, now[a])))
            now[a] = []
    for a, tokens in now.items():
        out.setdefault(a, set()).add(_hash(*map(str, tokens)))
    return out


def _spark_hash(text: str) -> int:
    """xxhash64() of Spark for one string."""
    return (xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=42) + (1 << 63)) % (1 << 64) - (1 << 63)


def _orders(batches: Iterator[pa.RecordBatch], by_name: bool = True) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found: dict[tuple[str, int], set[int]] = {}
            for host, html, of, spared in zip(*(part.column(k).to_pylist() for k in range(4))):
                for a, hashes in orders(html or "", {x["token"]: x["anchor"] for x in of}, set(spared or ()), by_name).items():
                    found.setdefault((host, a), set()).update(hashes)
            if found:
                yield batch_of(_ORDERS, zip(*((*k, min(v), max(v)) for k, v in found.items())))


def _disordered(pages: DataFrame, found: DataFrame, spared: DataFrame, by_name: bool = True) -> DataFrame:
    """(host, anchor) of the anchors whose texts do not come in one order. Only pages of hosts with anchors are read again."""
    of = found.groupBy("host").agg(F.collect_list(F.struct("token", "anchor")).alias("of")).join(spared, "host", "left")
    known = pages.select(_host().alias("host"), "html").join(scratch(of, "html-anchors"), "host").select("host", "html", "of", "spared")
    seen = known.mapInArrow(partial(_orders, by_name=by_name), "host string, anchor long, low long, high long")
    return seen.groupBy("host", "anchor").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("host", "anchor")


def _spared(by_path: DataFrame, pairs: DataFrame, tags: DataFrame) -> DataFrame:
    """host -> the paths of named out elements that hold most of its varying text, where no article or main element has text; known from MIN_PAGES pages on."""
    steady = pairs.select("host", "path", "out", "token", "chars").distinct()
    moving = by_path.unionByName(steady.select("host", "path", "out", (-F.col("chars")).alias("chars"))).groupBy("host", "path").agg(F.sum("chars").alias("chars"), F.min("out").alias("out"))
    held = moving.withColumn("container", F.explode(_above("path"))).groupBy("host", "container").agg(F.sum("chars").alias("held"))
    hosts = moving.groupBy("host").agg(F.sum("chars").alias("total"), F.max(~F.col("out") & F.col("path").rlike(r"/(article|main)(\.|/|$)")).alias("semantic")).where("not semantic").drop("semantic")
    last = F.element_at(F.split("container", "/"), -1)
    named = last.startswith("!") & ~F.ltrim(F.substring_index(last, ".", 1), F.lit("!")).isin(*NEVER)
    most = held.where(named).join(hosts, "host").where("held * 2 > total").join(tags.where(F.col("support") >= MIN_PAGES).select("host", "container"), ["host", "container"], "left_semi")
    return most.groupBy("host").agg(F.collect_set("container").alias("spared"))


def main_text(html: str, container: str | None = None, sure: bool = False, fixed: set[int] = frozenset(), spared: set[str] = frozenset(), by_name: bool = True) -> str:
    """Blocks in the main container without the template's texts, in page order, one a line.

    A heading of the template stays where the page's own text follows it; a page of nothing but template keeps it.
    """
    all_ = [(p, t) for p, out, t in page_blocks(html, spared, by_name) if t and not out]
    inside = [(p, t) for p, t in all_ if p == container or p.startswith(f"{container}/")] if container is not None else []
    if not inside or not sure and any(_is_main(p) for p, _ in all_):
        inside = [(p, t) for p, t in all_ if _is_main(p)] or all_
    same = [_hash(p, t) in fixed for p, t in inside] if fixed else [False] * len(inside)
    own = [t for k, (p, t) in enumerate(inside) if not same[k] or k + 1 < len(inside) and not same[k + 1] and _HEADING.search(p)]
    return "\n".join(t for _, t in inside) if all(same) else "\n".join(own)


def _tag(path: str) -> str:
    return path.rsplit("/", 1)[-1].lstrip("!").split(".", 1)[0]


def _is_main(path: str) -> bool:
    return any(s.split(".", 1)[0] in MAIN for s in path.split("/"))


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def _extract(batches: Iterator[pa.RecordBatch], by_name: bool = True) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            ids, urls, htmls, boxes, sure, fixed, spared = (part.column(k).to_pylist() for k in range(7))
            yield batch_of(_OUT, [ids, urls, [main_text(h or "", c, bool(s), set(f or ()), set(x or ()), by_name) for h, c, s, f, x in zip(htmls, boxes, sure, fixed, spared)]])


def _host() -> Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]*)", 1), F.lit("")))


def extract(pages: DataFrame, by_name: bool = True) -> DataFrame:
    """page_id, url and main text of every row. by_name False: by the deduced templates and slots alone, whatever parts are called.

    The templates are a written table of a row a host, so pages meet them in a join whose sides are plain exchanges:
    Spark broadcasts a small one, and else splits the pages of a hot host.
    """
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host().alias("host"))
    joined = keyed.join(scratch(templates(pages, by_name), "html-templates"), "host", "left").select("page_id", "url", "html", "container", "sure", "fixed", "spared")
    return joined.mapInArrow(partial(_extract, by_name=by_name), "page_id long, url string, text string")


def op9_html_template(spark, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
