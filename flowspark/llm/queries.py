"""Registered queries of this subpackage: name -> function(spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bytepair, chat, langid, lexical, manifest, neighbours, packing, pivots, quality, sentencepieces, simhash, urls, wavelet
from .tables import prepare, stored, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, folder: fn(prepare(spark), folder)
        return fn
    return add


@query("op1_wavelet")
def _(spark, d):
    return wavelet.documents_of(wavelet.written(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


@query("op2_quality")
def _(spark, d):
    docs = table(spark, d, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, d, "labels")))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op3_urls")
def _(spark, d):
    return urls.judged(table(spark, d, "pages"), urls.Policy(URL_RULES))


def _urls_sql() -> str:
    """The rules by length, longest first, and one pattern for each term of the vocabulary."""
    rules = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))

    def fits(host: str, path: str) -> str:
        return f"WHEN (host = '{host}' OR host LIKE '%.{host}') AND path LIKE '{path}%'"

    def term(text: str, value: str) -> str:
        return f"CASE WHEN regexp_matches(place, '(^|[^a-z0-9]){text}([^a-z0-9]|$)') THEN {value} ELSE 0 END"
    policy = urls.Policy(URL_RULES)
    strict = " + ".join(term(t, "1") for t in policy.strict)
    soft = " + ".join(term(t, "1") for t in policy.soft)
    weight = " + ".join(term(t, f"{w}::DOUBLE") for t, w in policy.soft.items())
    upper = "".join(map(chr, range(65, 91)))
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest,
         coalesce(translate(url, '{upper}', '{upper.lower()}'), '') AS place FROM pages),
parts AS (SELECT page_id, place, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{upper.lower()}'), '') AS host,
                 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
found AS (SELECT *, CASE {" ".join(f"{fits(h, p)} THEN '{h}{p}'" for h, p, _ in rules)} END AS rule,
                 CASE {" ".join(f"{fits(h, p)} THEN '{v}'" for h, p, v in rules)} END AS given FROM parts),
hits AS (SELECT *, CAST({strict} AS INTEGER) AS strict_hits, CAST({soft} AS INTEGER) AS soft_hits, CAST({weight} AS DOUBLE) AS soft_weight FROM found)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN strict_hits > 0 OR soft_hits > 1 AND soft_weight >= {policy.soft_limit} THEN 'block' ELSE 'allow' END) AS verdict,
       strict_hits, soft_hits, soft_weight FROM hits"""


ORACLES["op3_urls"] = _urls_sql()


@query("op4_packing")
def _(spark, d):
    return packing.packed_documents(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_bytepair")
def _(spark, d):
    return bytepair.round_trip(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op6_langid")
def _(spark, d):
    docs = table(spark, d, "documents")
    return langid.predicted(docs, langid.train(docs))


@query("op7_neighbours")
def _(spark, d):
    return neighbours.nearest(table(spark, d, "embeddings"))


@query("op8_chat")
def _(spark, d):
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(stored(chat.windows(rows, public_tokenizers.path("byte_bpe_50k.json")), "windows"))


@query("op9_simhash")
def _(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents").select("doc_id", "text"))


@query("op10_pivots")
def _(spark, d):
    return pivots.nearest(table(spark, d, "embeddings"))


ORACLES["op10_pivots"] = """
WITH sound AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS x FROM embeddings
               WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)),
v AS (SELECT vec_id, [floor(1024 * c)::BIGINT for c in x] AS x FROM sound),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum([q.x[i] * c.x[i] for i in range(1, len(q.x) + 1)])::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x))
SELECT query_id, rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored) WHERE rank <= 10"""


@query("op11_merkle")
def _(spark, d):
    return manifest.documents(table(spark, d, "documents")).verified()


def _manifest_sql() -> str:
    """Trees of up to 16 ** 7 documents a source and 16 ** 5 sources, a level at a time."""
    upper = "".join(map(chr, range(65, 91)))
    texts = {"text": "text", "lowered": f"translate(text, '{upper}', '{upper.lower()}')"}

    def leaf(text: str) -> str:
        values = [texts[text] if c == "text" else f"{c}::VARCHAR" for c in manifest.FIELDS]
        return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END" for v in values) + ")"
    table_ = [0] * 16                                          # of the reflected polynomial, by half bytes
    for i in range(16):
        value = i
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table_[i] = value
    halves = "flatten([[unicode(c) & 15, unicode(c) >> 4] for c in string_split(doc_id::VARCHAR, '')])"
    crc = (f"xor(list_reduce(list_prepend(4294967295::BIGINT, [h::BIGINT for h in {halves}]), "
           f"lambda a, h: xor({table_}[(xor(a, h) & 15) + 1]::BIGINT, a >> 4)), 4294967295::BIGINT)")
    steps = [f"""leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM (
        SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf("lowered")} END AS claim FROM documents)),
    s0 AS MATERIALIZED (SELECT source, i, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM leaves),
    w0 AS (SELECT doc_id, source, leaf, i, coalesce(claim, leaf) AS now, '' AS proof FROM leaves)"""]

    def climb(k: int, s: str, r: str, walk: str, after: str, group: str, meets: str) -> None:
        steps.append(f"""{r}{k} AS MATERIALIZED (SELECT {group} i // 16 AS i, string_agg(node, '' ORDER BY i) AS run FROM {s}{k - 1} WHERE n > 1 GROUP BY ALL),
    {s}{k} AS MATERIALIZED (SELECT {group} i, sha256(run) AS node, count(*) OVER ({"PARTITION BY source" if group else ""}) AS n FROM {r}{k}
        UNION ALL SELECT {group} 0, node, 1 FROM {s}{k - 1} WHERE n = 1),
    {after} AS MATERIALIZED (SELECT w.* EXCLUDE (i, now, proof), w.i // 16 AS i,
        CASE WHEN run IS NULL THEN now ELSE sha256(substr(run, 1, 64 * (w.i % 16)) || now || substr(run, 64 * (w.i % 16) + 65)) END AS now,
        proof || coalesce(substr(run, 1, 64 * (w.i % 16)) || substr(run, 64 * (w.i % 16) + 65), '') AS proof
        FROM {walk} w LEFT JOIN {r}{k} r ON {meets} r.i = w.i // 16)""")
    for k in range(1, 8):
        climb(k, "s", "r", f"w{k - 1}", f"w{k}", "source,", "r.source IS NOT DISTINCT FROM w.source AND")
    steps.append("""t0 AS MATERIALIZED (SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM s7),
    x0 AS (SELECT w7.* EXCLUDE (i), t0.node AS subroot, t0.i FROM w7 JOIN t0 ON t0.source IS NOT DISTINCT FROM w7.source)""")
    for k in range(1, 6):
        climb(k, "t", "q", f"x{k - 1}", f"x{k}", "", "")
    return "WITH " + ",\n".join(steps) + """
SELECT doc_id, x5.source, leaf, subroot, t5.node AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = t5.node AS verified FROM x5, t5"""


ORACLES["op11_merkle"] = _manifest_sql()


@query("op12_sentencepiece")
def _(spark, d):
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepieces.digests(sentencepieces.decoded(sentencepieces.encoded(table(spark, d, "documents"), model), model))


@query("op13_lexical")
def _(spark, d):
    return lexical.search(table(spark, d, "documents"), table(spark, d, "benchmark"))


_UPPER = "".join(map(chr, range(65, 91)))
ORACLES["op13_lexical"] = f"""
WITH terms AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{lexical.TERM}')) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM sizes),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
wanted AS (SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{lexical.TERM}')) AS term FROM benchmark) GROUP BY item_id, term),
weights AS (SELECT term, floor(1000 * ln((2.0 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, corpus GROUP BY term),
scores AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // len))))::BIGINT AS score
           FROM wanted JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), corpus GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0) WHERE rank <= {lexical.TOP}"""
