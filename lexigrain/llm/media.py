"""Interleaved document sequences from HTML (operator 5).

One scan of a page's markup gives its visible text blocks and media references in document order, as an
array of structs: ``position``, ``kind`` (text, image, video, audio, embed), ``text``, ``src`` (absolute),
``alt``, ``caption``, ``digest``. A media element inside a figure has the figure's caption, which then isn't
a text block of its own. The digest is the SHA-256 of the bytes of a data URI, or of the absolute URL
otherwise; a join on it resolves payloads from a media table (digest, payload, mime). Only references take
part in that exchange, never text; resolved payloads come back by (page, position), so the arrays stay
aligned whatever was found.

Markup is read as browsers read it: end tags that may be left out may be (a head ends where its first body element
begins), script, style and the like hold text that isn't markup, an SVG that isn't closed ends at the next HTML element,
``base`` changes what addresses are relative to, and content for browsers without scripts is content. An image's source
is its lazy-loading address, else ``src``, else the largest of ``srcset``, else that of the ``picture`` around it.

Defined cases: null or empty HTML gives an empty sequence; broken markup is read as far as it makes sense,
open elements end with the page, a tag that isn't ended is dropped; pages of any length are read whole, in time in proportion to it;
a second reference to the same source right after the first (as in ``noscript``) counts once; a reference without a source is left out; a digest with several payloads
takes the smallest; unresolved references keep null ``payload`` and ``mime``; rows that share an id are
told apart by a row number and each keep their sequence; columns of other names don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"(?P<text>[^<]++)"
    r"|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+)>"
    r"|<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z|(?P<lone><)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?+)?+")
#: Elements whose text isn't markup, each with what ends it.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "title", "xmp", "iframe", "noembed", "noframes", "template")}
_HEAD = frozenset("html head title meta link base basefont bgsound script style template noscript noframes".split())
_OUT_OF_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
_LAZY = ("data-src", "data-original", "data-lazy-src", "data-lazy")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_KINDS = {"img": "image", "image": "image", "video": "video", "audio": "audio", "source": None, "embed": "embed", "object": "embed", "iframe": "embed", "input": "image"}
_MEDIA = "(?i)<(?:" + "|".join(_KINDS) + r")\b"
_SPACE = re.compile(r"\s+")

ITEM = "struct<position:int,kind:string,text:string,src:string,alt:string,caption:string,digest:string>"
_ARROW = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "src", "alt", "caption", "digest"))]))


def digest(source: str) -> str:
    """SHA-256 of a data URI's bytes, or of the URL."""
    if source[:5].lower() == "data:" and "," in source:
        head, body = source.split(",", 1)
        raw = unquote_to_bytes(body)
        if head.lower().endswith(";base64"):
            try:
                raw = base64.b64decode(raw, validate=False)
            except ValueError:
                pass
        return hashlib.sha256(raw).hexdigest()
    return hashlib.sha256(source.encode("utf-8", "replace")).hexdigest()


def attributes(rest: str) -> dict[str, str]:
    """The attributes of a tag; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").strip())
    return out


def largest(srcset: str) -> str | None:
    """The candidate of a ``srcset`` with the largest width or density, the first of equal ones."""
    best, most = None, -1.0
    for m in re.finditer(r"\s*([^\s,]\S*?)(,+(?=\s|$)|\s+([^,]*)(?:,|$)|$)", srcset):
        try:
            size = float((m[3] or "1x").split()[0][:-1]) if (m[3] or "").strip() else 1.0
        except ValueError:
            size = 1.0
        if size > most:
            best, most = m[1], size
    return best


def _source(values: dict[str, str]) -> str | None:
    lazy = next((values[k] for k in _LAZY if values.get(k)), None) or largest(values.get("data-srcset", ""))
    return lazy or values.get("src") or largest(values.get("srcset", "")) or next((values[k] for k in ("data", "href", "xlink:href") if values.get(k)), None)


def sequence(page: str | None, base: str | None) -> list[dict]:
    """The text blocks and media references of a page, in order."""
    items: list[dict] = []
    words: list[str] = []
    caption: list[str] | None = None
    figure: int | None = None
    held: list[str] = []
    player: dict | None = None
    picture: str | None = None
    head, svg, based = False, False, False
    page = page or ""

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(words)).strip()
        words.clear()
        if text:
            if caption is not None:
                held.append(text)
            else:
                items.append({"kind": "text", "text": text})

    def close_figure() -> None:
        nonlocal figure, caption
        flush()
        text = " ".join(held)
        held.clear()
        inside = [x for x in items[figure or 0 :] if x["kind"] != "text"] if figure is not None else []
        for x in inside:
            x["caption"] = text or None
        if text and not inside:
            items.append({"kind": "text", "text": text})
        figure = caption = None

    at = 0
    while token := _TOKEN.match(page, at):
        at = token.end()
        if token["text"] is not None or token["lone"]:
            if not svg and not (head and token[0].isspace()):
                head = False
                words.append(html.unescape(token[0]))
            continue
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if head and (tag not in _HEAD or (token["close"] and tag == "head")):
            head = False
        if svg and ((token["close"] and tag == "svg") or tag in _OUT_OF_SVG):
            svg = False
        if tag in _RAW and not token["close"]:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            if tag != "iframe":
                continue
        if tag in _INLINE:
            continue
        if token["close"]:
            flush()
            if tag == "figcaption":
                caption = None
            elif tag == "figure" and figure is not None:
                close_figure()
            elif tag in ("video", "audio", "object"):
                player = None
            elif tag == "picture":
                picture = None
            continue
        if tag == "head":
            head = True
        elif tag == "svg":
            svg = not token["rest"].rstrip().endswith("/")
        elif tag == "base" and not based:
            address = attributes(token["rest"]).get("href")
            base, based = (_join(base, address), True) if address else (base, False)
        if svg and tag not in ("svg", "image"):
            continue
        flush()
        if tag == "figure":
            if figure is not None:
                close_figure()
            figure = len(items)
        elif tag == "figcaption" and figure is not None:
            caption = []
        elif tag == "picture":
            picture = ""
        elif tag in _KINDS:
            values = attributes(token["rest"])
            if tag == "input" and values.get("type", "").lower() != "image":
                continue
            source = _source(values)
            if tag == "source":
                if player is not None and player["src"] is None and source:
                    player["src"] = _join(base, source)
                elif picture == "" and source:
                    picture = source
                continue
            item = {"kind": _KINDS[tag], "src": _join(base, source or (picture if tag == "img" else None)), "alt": values.get("alt") or values.get("title") or None}
            if items and item["src"] and items[-1].get("src") == item["src"] and items[-1]["kind"] == item["kind"]:
                continue
            items.append(item)
            if tag in ("video", "audio", "object") and not token["rest"].rstrip().endswith("/"):
                player = item
    flush()
    if figure is not None:
        close_figure()
    out = [x for x in items if x["kind"] == "text" or x["src"]]
    for i, x in enumerate(out):
        x["position"] = i
        if x["kind"] != "text":
            x["digest"] = digest(x["src"])
    return out


def _join(base: str | None, source: str | None) -> str | None:
    if not source or source[:5].lower() == "data:":
        return source
    try:
        return urljoin(base or "", source)
    except ValueError:
        return source


def sequences(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, row, items): ``row`` tells rows of one key apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column("url")
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                items = [sequence(p, u) for p, u in zip(part.column("html").to_pylist(), urls.slice(at, 512).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("url"), pa.array(items, _ARROW)], names=[key, "url", "items"])

    rows = pages.select(F.col(key).cast("long").alias(key), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = rows.mapInArrow(run, f"{key} long, url string, items array<{ITEM}>")
    return parsed.withColumn("row", F.xxhash64(key, "url", "items")).withColumn("row2", F.xxhash64("items", "url", key, F.lit(1)))


def resolve(found: DataFrame, media: DataFrame) -> DataFrame:
    """Adds ``payload`` and ``mime`` to every item, by digest. Pages and their references meet by a 128-bit row key."""
    stored = media.where("digest is not null").groupBy("digest").agg(F.min(F.struct("payload", "mime")).alias("x")).select("digest", "x.payload", "x.mime")
    wanted = found.where(F.exists("items", lambda x: x["digest"].isNotNull())).select("row", "row2", F.explode("items").alias("x")).where("x.digest is not null")
    wanted = wanted.select("row", "row2", F.col("x.position").alias("position"), F.col("x.digest").alias("digest")).distinct()
    got = wanted.join(stored.hint("merge"), "digest").groupBy("row", "row2").agg(F.map_from_entries(F.collect_list(F.struct("position", F.struct("payload", "mime")))).alias("payloads"))
    at = lambda x, field: F.element_at("payloads", x["position"])[field]
    return found.join(got.hint("merge"), ["row", "row2"], "left").withColumn("items", F.transform("items", lambda x: x.withField("payload", at(x, "payload")).withField("mime", at(x, "mime")))).drop("payloads")


def interleaved(pages: DataFrame, media: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, n_text, n_media, n_resolved, items) of every page."""
    # Only pages whose markup has a media element at all take part in the exchange.
    some = F.coalesce(F.col("html").cast("string").rlike(_MEDIA), F.lit(False))
    done = resolve(sequences(pages.where(some), key), media)
    payload, mime = (media.schema[c].dataType for c in ("payload", "mime"))
    plain = sequences(pages.where(~some), key).withColumn("items", F.transform("items", lambda x: x.withField("payload", F.lit(None).cast(payload)).withField("mime", F.lit(None).cast(mime))))
    done = done.unionByName(plain)
    count = lambda f: F.size(F.filter("items", f))
    return done.select(
        key, "url", count(lambda x: x["kind"] == "text").alias("n_text"), count(lambda x: x["kind"] != "text").alias("n_media"), count(lambda x: x["payload"].isNotNull()).alias("n_resolved"), "items"
    )
