"""URL filters with a weighted vocabulary (operator 4).

An Aho-Corasick automaton finds all terms in the lower-cased URL, its percent escapes decoded once, in one walk; a
hit counts when no ASCII letter or digit stands right before or after it. A URL is rejected on one strict term, or on
``SOFT_LIMIT`` different soft terms whose weights come to ``SOFT_WEIGHT`` together. ``weight`` sums the weights of
the different terms hit.

``STRICT`` and ``SOFT`` are a starting vocabulary of several languages. ``vocabulary`` reads another from a table
(term, strict, weight); it is sent to every task, so it may hold ``MOST_TERMS`` terms at most and more are refused.

Defined cases: a null URL hits nothing and isn't rejected (its ``weight`` is 0); an empty one likewise; URLs of any
length are read whole, in one walk; escapes of invalid UTF-8 become replacement characters; of a term in both lists
the strict one counts; null and empty terms are left out and a null weight is 1; repeated rows are each judged;
columns of other names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOFT_LIMIT = 2
SOFT_WEIGHT = 0.5
MOST_TERMS = 1_000_000

_STRICT_TERMS = {
    1.0: "casino casinos kasino porn porno pornos xxx viagra cialis levitra escort escorts hentai blackjack malware keygen keygens phishing camgirl camgirls webcamsex sexcam milf bdsm nsfw upskirt gangbang",
    0.9: "slots slotmachine betting sportsbook payday-loan payday-loans wettanbieter sportwetten apuestas paris-sportifs tragaperras spielautomaten replica-watches fake-id buy-followers darkweb ransomware spyware trojan",
    0.8: "torrents warez crack cracks cracked nulled serialz torrent piratebay tramadol xanax oxycodone ephedrine phentermine sildenafil tadalafil",
}
_SOFT_TERMS = {
    0.5: "bet bets pills poker jackpot lottery lotto roulette sexy baccarat bingo gamble gambling glücksspiel loteria loterie erotik erotic erotique erotico",
    0.4: "cheap ads adult dating loan loans kredit credito singles hookup flirt steroids weightloss forex binary-options crypto-profit adserver doubleclick popunder affiliate",
    0.3: "win winner bonus prize promo track tracker tracking pharma pharmacy apotheke farmacia pharmacie discount rabatt descuento giveaway gewinn gewinner banner redirect sponsored",
    0.2: "free gratis gratuit click clicks offer offers deal deals coupon outlet utm subscribe",
    0.1: "download downloads install apk exe",
}
STRICT = {t: w for w, terms in _STRICT_TERMS.items() for t in terms.split()}
SOFT = {t: w for w, terms in _SOFT_TERMS.items() for t in terms.split()}


def vocabulary(table: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Strict and soft terms of a table (term, strict, weight)."""
    terms = table.select(F.lower(F.trim(F.col("term").cast("string"))).alias("term"), F.coalesce(F.col("strict").cast("boolean"), F.lit(False)).alias("strict"), F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"))
    rows = terms.where("term <> ''").groupBy("term").agg(F.max("strict").alias("strict"), F.max("weight").alias("weight")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a vocabulary holds {MOST_TERMS} terms at most")
    return {r["term"]: r["weight"] for r in rows if r["strict"]}, {r["term"]: r["weight"] for r in rows if not r["strict"]}


def automaton(strict: dict[str, float] = STRICT, soft: dict[str, float] = SOFT):
    import ahocorasick

    out = ahocorasick.Automaton()
    for hard, terms in ((False, soft), (True, strict)):
        for term, weight in terms.items():
            out.add_word(term.lower(), (term.lower(), hard, weight))
    out.make_automaton()
    return out


def _inner(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def hits(machine, url: str) -> tuple[list[str], list[str], float]:
    """Different strict and soft terms of a URL, each sorted, and the sum of their weights."""
    text, found = (unquote(url) if "%" in url else url).lower(), {}
    for last, (term, hard, weight) in machine.iter(text):
        begin = last - len(term) + 1
        if not (begin and _inner(text[begin - 1])) and not (last + 1 < len(text) and _inner(text[last + 1])):
            found[term] = hard, weight
    return sorted(t for t, x in found.items() if x[0]), sorted(t for t, x in found.items() if not x[0]), sum(found[t][1] for t in sorted(found))


def rejects(strict: list[str], soft: list[str], weights: dict[str, float], soft_limit: int = SOFT_LIMIT, soft_weight: float = SOFT_WEIGHT) -> bool:
    """Whether these hits reject a URL."""
    return bool(strict) or (len(soft) >= soft_limit and round(sum(weights[t] for t in soft), 6) >= soft_weight)


def judge(pages: DataFrame, key: str = "page_id", strict: dict[str, float] = STRICT, soft: dict[str, float] = SOFT, soft_limit: int = SOFT_LIMIT, soft_weight: float = SOFT_WEIGHT) -> DataFrame:
    """(key, url, n_strict, n_soft, weight, rejected) of every row; reads no other column and exchanges nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, weights = automaton(strict, soft), {t.lower(): w for t, w in soft.items()}
        for batch in batches:
            rows = [hits(machine, u) if u else ([], [], 0.0) for u in batch.column("url").to_pylist()]
            n_strict, n_soft = [len(r[0]) for r in rows], [len(r[1]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    batch.column("url"),
                    pa.array(n_strict, pa.int32()),
                    pa.array(n_soft, pa.int32()),
                    pa.array([round(r[2], 6) for r in rows], pa.float64()),
                    pa.array([rejects(r[0], r[1], weights, soft_limit, soft_weight) for r in rows], pa.bool_()),
                ],
                names=[key, "url", "n_strict", "n_soft", "weight", "rejected"],
            )

    urls = pages.select(F.col(key).cast("long").alias(key), F.col("url").cast("string").alias("url"))
    return urls.mapInArrow(run, f"{key} long, url string, n_strict int, n_soft int, weight double, rejected boolean")


def oracle_sql(key: str = "page_id", strict: dict[str, float] = STRICT, soft: dict[str, float] = SOFT, soft_limit: int = SOFT_LIMIT, soft_weight: float = SOFT_WEIGHT) -> str:
    """The same rows in DuckDB SQL, one regular expression a term."""
    both = {**soft, **strict}
    rows = ", ".join(f"('{t}', {t in strict}, {w})" for t, w in both.items())
    return f"""
        WITH vocabulary(term, strict, weight) AS (VALUES {rows}),
        plain AS (SELECT DISTINCT url, lower(url_decode(url)) AS plain FROM pages WHERE url IS NOT NULL),
        hits AS (SELECT url, strict, weight FROM plain JOIN vocabulary ON contains(plain, term) AND regexp_matches(plain, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])')),
        counted AS (
            SELECT url, count(*) FILTER (strict) AS n_strict, count(*) FILTER (NOT strict) AS n_soft, round(CAST(sum(weight) AS DOUBLE), 6) AS weight,
                coalesce(round(CAST(sum(weight) FILTER (NOT strict) AS DOUBLE), 6), 0) AS soft_weight
            FROM hits GROUP BY url)
        SELECT {key}, url, CAST(coalesce(n_strict, 0) AS INTEGER) AS n_strict, CAST(coalesce(n_soft, 0) AS INTEGER) AS n_soft, coalesce(weight, 0.0) AS weight,
            coalesce(n_strict > 0 OR (n_soft >= {soft_limit} AND soft_weight >= {soft_weight}), FALSE) AS rejected
        FROM pages LEFT JOIN counted USING (url)"""
