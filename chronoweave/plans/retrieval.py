"""Queries of search, resolution, merging, privacy, recall, sessions and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions import scores, text
from chronoweave.operators import evaluation, extraction, merging, privacy, recall, resolution, search
from chronoweave.operators import graph as reads
from chronoweave.plans.graph import _DAYS, CLEAN, NOW, aliases, at, entities, properties, relationships, source_refs
from chronoweave.schema import one_record
from chronoweave.sources.tables import cut, micros, scan
from chronoweave.streaming import scratchpad

QUERIES, SQL = {}, {}


def query(sql: str | None = None, clean: bool = True):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = CLEAN + sql if clean else sql
        return function

    return register


def chunks(s, d):
    return one_record(scan(s, d, "verbatim_chunks").drop("embedding")).withColumnRenamed("id", "chunk_id")


def access_log(s, d):
    return one_record(scan(s, d, "access_log"))


_CHUNKS = """, c AS (SELECT id AS chunk_id, conversation_id, turn_number, text, participant FROM verbatim_chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY
  conversation_id DESC NULLS LAST, turn_number DESC NULLS LAST, text DESC NULLS LAST, timestamp DESC NULLS LAST, participant DESC NULLS LAST, source_type DESC NULLS LAST) = 1)
"""
_TOKENS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"
_READ = _CHUNKS + f""", t AS (SELECT chunk_id, coalesce({_TOKENS.format("text")}, []) AS terms FROM c),
q AS (SELECT DISTINCT name AS query_id, {_TOKENS.format("name")} AS asked FROM e WHERE type = 'organization' AND name IS NOT NULL),
corpus AS (SELECT count(*) AS chunks, sum(len(terms)) / count(*) AS mean_length FROM t)
"""


def _organizations(s, d):
    return entities(s, d).where("type = 'organization' and name is not null").select(F.col("name").alias("query_id"), F.col("name").alias("text")).distinct()


@query(_CHUNKS + "SELECT conversation_id, turn_number, chunk_id, text, row_number() OVER (PARTITION BY conversation_id ORDER BY turn_number, chunk_id) AS place FROM c WHERE conversation_id <> ''")
def conversation_fetch(s, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy("turn_number", "chunk_id"))
    return chunks(s, d).where("conversation_id <> ''").select("conversation_id", "turn_number", "chunk_id", "text", place.alias("place"))


def _vectors(s, d):
    return scan(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


_QUERY_VECTORS = "SELECT a.vec_id AS q, b.vec_id AS c, {} AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0"


@query(f"""SELECT CAST(q AS VARCHAR) AS query_id, CAST(c AS VARCHAR) AS chunk_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, CAST(c AS VARCHAR)) - 1 AS rank FROM
(SELECT q, c, round(distance, 6) AS distance FROM ({_QUERY_VECTORS.format("sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)))")}))) WHERE rank < 10""", clean=False)
def vector_topk(s, d):
    vectors = _vectors(s, d)
    return search.vector_top_k(vectors.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), vectors)


@query(f"""SELECT CAST(q AS VARCHAR) AS query_id, CAST(c AS VARCHAR) AS chunk_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, CAST(c AS VARCHAR)) - 1 AS rank FROM
(SELECT q, c, round(distance, 6) AS distance FROM ({_QUERY_VECTORS.format("1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])")}))) WHERE rank < 10""", clean=False)
def cosine_topk(s, d):
    vectors = _vectors(s, d)
    return search.vector_top_k(vectors.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), vectors, metric="cosine")


_PHRASE = _READ + """, f AS (SELECT query_id, chunk_id, len(terms) AS length, len(list_filter(range(1, len(terms) + 1), lambda i: terms[i:i + len(asked) - 1] = asked)) AS frequency
  FROM t, q WHERE len(asked) > 0 AND list_has_all(terms, asked)),
g AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM f WHERE frequency > 0),
b AS (SELECT query_id, chunk_id, frequency, (CASE WHEN ln((chunks - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((chunks - n + 0.5) / (n + 0.5)) END)
  * frequency * 2.2 / (frequency + 1.2 * (0.25 + 0.75 * length / mean_length)) AS bm25 FROM g, corpus)
"""


@query(_PHRASE + """SELECT query_id, chunk_id, round(bm25, 6) AS bm25, round(1 / (1 + bm25), 6) AS score FROM b
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, chunk_id) <= 10""")
def bm25_phrase(s, d):
    found = search.bm25_phrase(_organizations(s, d), chunks(s, d).select("chunk_id", "text"))
    return found.select("query_id", "chunk_id", F.round("bm25", 6).alias("bm25"), F.round("score", 6).alias("score"))


@query(_READ + """, w AS (SELECT DISTINCT query_id, unnest(asked) AS term FROM q),
x AS (SELECT chunk_id, len(terms) AS length, unnest(terms) AS term FROM t), y AS (SELECT chunk_id, length, term, count(*) AS frequency FROM x GROUP BY ALL),
z AS (SELECT *, count(*) OVER (PARTITION BY term) AS n FROM y),
p1 AS (SELECT query_id, chunk_id, round(sum((CASE WHEN ln((chunks - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((chunks - n + 0.5) / (n + 0.5)) END)
  * frequency * 2.2 / (frequency + 1.2 * (0.25 + 0.75 * length / mean_length))), 9) AS bm25 FROM z JOIN w USING (term), corpus GROUP BY 1, 2)
SELECT query_id, chunk_id, round(bm25, 6) AS bm25 FROM p1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) <= 10""")
def bm25_terms(s, d):
    return search.bm25_terms(_organizations(s, d), chunks(s, d).select("chunk_id", "text")).select("query_id", "chunk_id", F.round("bm25", 6).alias("bm25"))


_PLACES = "list_transform({}, lambda w: CAST('0x' || md5(w)[1:6] AS INT) % 8)"
_COUNTED = "list_transform(range(8), lambda i: len(list_filter({}, lambda p: p = i))::DOUBLE)"
_UNIT = "list_transform({0}, lambda v: CASE WHEN list_sum(list_transform({0}, lambda z: z * z)) > 0 THEN v / sqrt(list_sum(list_transform({0}, lambda z: z * z))) ELSE 0.0 END)"
_HASHED = f"""qe AS (SELECT query_id, {_UNIT.format("n")} AS qv FROM (SELECT query_id, {_COUNTED.format(_PLACES.format("asked"))} AS n FROM q)),
ce AS (SELECT chunk_id, {_UNIT.format("n")} AS cv FROM (SELECT chunk_id, {_COUNTED.format(_PLACES.format("terms"))} AS n FROM t JOIN c USING (chunk_id) WHERE text IS NOT NULL)),
far AS (SELECT query_id, chunk_id, round(sqrt(greatest(0, list_sum(list_transform(list_zip(qv, cv), lambda p: (p[1] - p[2]) ** 2)))), 6) AS distance FROM qe, ce)
"""


@query(_PHRASE + ", " + _HASHED + """, lists AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) - 1 AS rank FROM far QUALIFY rank < 10
UNION ALL SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, chunk_id) - 1 AS rank FROM b QUALIFY rank < 10)
SELECT query_id, chunk_id, round(score, 9) AS score FROM (SELECT query_id, chunk_id, round(sum(1.0 / (61 + rank)), 12) AS score FROM lists GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10""")
def rrf_hybrid(s, d):
    asked = _organizations(s, d)
    texts = chunks(s, d).where("text is not null").select("chunk_id", search.hash_embedding(F.col("text")).alias("embedding"))
    near = search.shared_top_k(asked.select("query_id", search.hash_embedding(F.col("text")).alias("embedding")), texts)
    return search.fuse(near, search.bm25_phrase(asked, chunks(s, d).select("chunk_id", "text"))).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@query(_PHRASE + """, hit AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, chunk_id) - 1 AS rank FROM b QUALIFY rank < 10),
fst AS (SELECT query_id, conversation_id, min(rank) AS first FROM hit JOIN c USING (chunk_id) WHERE conversation_id <> '' GROUP BY 1, 2),
kept AS (SELECT query_id, conversation_id, row_number() OVER (PARTITION BY query_id ORDER BY first, conversation_id) - 1 AS conversation_rank FROM fst QUALIFY conversation_rank < 5)
SELECT query_id, conversation_rank, conversation_id, turn_number, chunk_id FROM kept JOIN c USING (conversation_id)""")
def verbatim_conversations(s, d):
    found = search.bm25_phrase(_organizations(s, d), chunks(s, d).select("chunk_id", "text"))
    return search.expand_conversations(found, chunks(s, d))


# the SQL engine's distance counts bytes, so accented letters are given single-byte stand-ins first
_ACCENTED = "áàâäãåæçéèêëíìîïñóòôöõøúùûüýßłřšž"
_ONE_BYTE = "translate(lower({}), '" + _ACCENTED + "', " + " || ".join(f"chr({n})" for n in [*range(1, 32), 94, 96, *range(123, 128)][: len(_ACCENTED)]) + ")"
_DISTANCE = f"levenshtein({_ONE_BYTE.replace('{}', '{0}')}, {_ONE_BYTE.replace('{}', '{1}')})"
_SIM = "(CASE WHEN greatest(len({0}), len({1})) = 0 THEN 1.0 ELSE 1 - " + _DISTANCE + " / greatest(len({0}), len({1})) END)"


@query(f"SELECT a.id AS alias_id, round({_SIM.format('alias', 'name')}, 6) AS similarity FROM a JOIN e ON e.id = a.entity_id WHERE alias IS NOT NULL")
def name_similarity(s, d):
    joined = aliases(s, d).withColumnRenamed("id", "alias_id").join(entities(s, d).select(F.col("id").alias("entity_id"), "name"), "entity_id").where("alias is not null")
    return joined.select("alias_id", F.round(text.edit_similarity(F.col("alias"), F.col("name")), 6).alias("similarity"))


_U = "upper(trim(w))"
_DIGITS = f"regexp_replace(translate(regexp_replace({_U}, '[^A-Z]', '', 'g'), 'BFPVCGJKQSXZDTLMNR', '111122222222334556'), '[^1-6]', '', 'g')"
_RUNS = _DIGITS
for _digit in "123456":
    _RUNS = f"regexp_replace({_RUNS}, '{_digit}{_digit}+', '{_digit}', 'g')"
_SOUNDEX = f"CASE WHEN {_U} = '' THEN '' ELSE rpad(substr({_U}, 1, 1) || CASE WHEN regexp_matches(substr({_U}, 1, 1), '[BFPVCGJKQSXZDTLMNR]') THEN substr({_RUNS}, 2) ELSE {_RUNS} END, 4, '0')[1:4] END"


@query(f"SELECT DISTINCT w AS word, {_SOUNDEX} AS code FROM (SELECT unnest(string_split(name, ' ')) AS w FROM e) WHERE w <> ''")
def soundex_codes(s, d):
    word = entities(s, d).select(F.explode(F.split("name", " ")).alias("word")).where("word <> ''").distinct()
    return word.select("word", text.soundex(F.col("word")).alias("code"))


def _codes(column: str) -> str:
    return f"list_transform(list_filter(regexp_split_to_array(trim({column}), '\\s+'), lambda w: len(w) > 1), lambda w: {_SOUNDEX})"


@query(f"""SELECT alias_id, round(CASE WHEN len(x) * len(y) > 0 THEN list_sum(list_transform(x, lambda c: len(list_filter(y, lambda k: k = c)))) / (len(x) * len(y)) ELSE 0 END, 6) AS phonetic
FROM (SELECT a.id AS alias_id, {_codes("alias")} AS x, {_codes("name")} AS y FROM a JOIN e ON e.id = a.entity_id WHERE alias IS NOT NULL AND name IS NOT NULL)""")
def phonetic_match(s, d):
    joined = aliases(s, d).withColumnRenamed("id", "alias_id").join(entities(s, d).select(F.col("id").alias("entity_id"), "name"), "entity_id").where("alias is not null and name is not null")
    return joined.select("alias_id", F.round(text.phonetic_match(F.col("alias"), F.col("name")), 6).alias("phonetic"))


def _mentions(s, d):
    return entities(s, d).where("merged_into is not null").select(F.col("id").alias("mention_id"), "name", "type")


_PAIRS = """, m AS (SELECT id AS mention_id, name, type FROM e WHERE merged_into IS NOT NULL),
probe AS (SELECT mention_id, name AS probe FROM m UNION SELECT mention_id, w FROM (SELECT mention_id, unnest(regexp_split_to_array(trim(name), '\\s+')) AS w, len(list_filter(regexp_split_to_array(trim(name), '\\s+'), lambda z: z <> '')) AS n FROM m) WHERE n > 1 AND len(w) > 2),
pairs AS (SELECT DISTINCT mention_id, entity_id FROM probe JOIN surfaces ON contains(lower(surface), lower(probe)))
"""


@query(_PAIRS + "SELECT mention_id, entity_id FROM pairs")
def resolve_candidates(s, d):
    known = entities(s, d).where("not archived")
    return resolution.candidates(_mentions(s, d), reads.surfaces(known, aliases(s, d)))


def _known(s, d):
    """Active entities with their order and number of connected ones."""
    known = entities(s, d)
    near = resolution.connections(known, relationships(s, d)).withColumnRenamed("entity_id", "id")
    return cut(resolution.numbered(known.where("not archived")).join(near, "id", "left"))


_PHON = "(CASE WHEN len(x) * len(y) > 0 THEN coalesce(list_sum(list_transform(x, lambda c: len(list_filter(y, lambda k: k = c)))), 0) / (len(x) * len(y)) ELSE 0.0 END)"
_SIGNALS = _PAIRS + f""", g0 AS (SELECT mention_id, pairs.entity_id, m.name, m.type, e.name AS entity_name, e.type AS entity_type, e.last_seen, {_codes("m.name")} AS x, {_codes("e.name")} AS y,
  (SELECT max({_SIM.format("m.name", "alias")}) FROM a WHERE a.entity_id = pairs.entity_id AND alias IS NOT NULL) AS alias_match FROM pairs JOIN m USING (mention_id) JOIN e ON e.id = pairs.entity_id),
g AS (SELECT *, lower(name) = lower(entity_name) AS name_exact, {_SIM.format("name", "entity_name")} AS name_fuzzy, {_PHON} AS name_phonetic,
  CASE WHEN type = entity_type THEN 1.0 WHEN type IN ('person', 'organization', 'location') AND entity_type IN ('person', 'organization', 'location') THEN 0.0 ELSE 0.5 END AS type_match FROM g0)
"""
_FAST = "CASE WHEN name_exact AND type_match >= 0.5 THEN 0.95 WHEN alias_match = 1 AND type_match >= 0.5 THEN 0.92 ELSE {} END"
_TIER1 = _FAST.format("(name_fuzzy * 0.35 + name_phonetic * 0.1 + coalesce(alias_match * 0.25, 0) + type_match * 0.3) / (CASE WHEN alias_match IS NULL THEN 0.75 ELSE 1.0 END)")


@query(_SIGNALS + f"SELECT mention_id, entity_id, round({_TIER1}, 6) AS score FROM g")
def resolve_tier1(s, d):
    found = resolution.candidate_signals(_mentions(s, d), entities(s, d).where("not archived"), aliases(s, d))
    return resolution.tier1_scores(found).select("mention_id", "entity_id", F.round("score", 6).alias("score"))


_NEAR = """, near AS (SELECT sym.entity_id, count(DISTINCT other_id) AS near FROM sym JOIN e ON e.id = other_id WHERE NOT archived AND other_id <> sym.entity_id GROUP BY 1),
mat AS (SELECT least((SELECT count(*) FROM r) / greatest((SELECT count(*) FROM e WHERE NOT archived), 1) / 3.0, 1.0) AS k)
"""
_TIER2 = _FAST.format(f"""(name_fuzzy * (0.35 - 0.1 * k) + name_phonetic * (0.08 - 0.03 * k) + coalesce(alias_match * (0.25 - 0.05 * k), 0) + type_match * (0.2 - 0.05 * k)
 + least(coalesce(near, 0) / 10.0, 1.0) * (0.02 + 0.1 * k) + coalesce(exp(-{_DAYS.format("last_seen")} / 30.0), 0.5) * (0.05 + 0.03 * k))
 / (0.7 - 0.05 * k + (CASE WHEN alias_match IS NULL THEN 0 ELSE 0.25 - 0.05 * k END))""")


@query(_SIGNALS + _NEAR + f"SELECT mention_id, entity_id, round({_TIER2}, 6) AS score FROM (SELECT g.*, near FROM g LEFT JOIN near USING (entity_id)), mat")
def resolve_tier2(s, d):
    found = resolution.candidate_signals(_mentions(s, d), _known(s, d), aliases(s, d))
    return resolution.tier2_scores(found, entities(s, d), relationships(s, d), at(NOW)).select("mention_id", "entity_id", F.round("score", 6).alias("score"))


@query(_SIGNALS + f""", b AS (SELECT *, round({_TIER1}, 9) AS score FROM g QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY round({_TIER1}, 9) DESC, entity_id) = 1),
k AS (SELECT * FROM b WHERE type_match > 0 AND score >= 0.85)
SELECT m.mention_id, CASE WHEN k.entity_id IS NULL THEN 'create' ELSE 'merge' END AS action, k.entity_id, round(score, 6) AS confidence,
  CASE WHEN k.name <> entity_name AND coalesce(alias_match, 0) < 1 THEN k.name END AS add_alias FROM m LEFT JOIN k USING (mention_id)""")
def resolve_decisions(s, d):
    told, named, known = _mentions(s, d), aliases(s, d), _known(s, d)
    pairs = resolution.best(resolution.tier1_scores(resolution.candidate_signals(told, known, named)), known)
    return resolution.decide(told, resolution.tier1_scores(resolution.signals(told, pairs, known, named)))


@query(_SIGNALS + _NEAR + f""", sc AS (SELECT *, round({_TIER2}, 9) AS score FROM (SELECT g.*, near FROM g LEFT JOIN near USING (entity_id)), mat),
b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, entity_id) = 1), k AS (SELECT * FROM b WHERE type_match > 0 AND score >= 0.85)
SELECT m.mention_id, CASE WHEN k.entity_id IS NULL THEN 'create' ELSE 'merge' END AS action, k.entity_id, round(score, 6) AS confidence,
  CASE WHEN k.name <> entity_name AND coalesce(alias_match, 0) < 1 THEN k.name END AS add_alias FROM m LEFT JOIN k USING (mention_id)""")
def resolve_tier2_decisions(s, d):
    told, named, known = _mentions(s, d), aliases(s, d), _known(s, d)
    scored = lambda found: resolution.tier2_scores(found, entities(s, d), relationships(s, d), at(NOW))
    pairs = resolution.best(scored(resolution.candidate_signals(told, known, named)), known)
    return resolution.decide(told, scored(resolution.signals(told, pairs, known, named)))


# chains are walked to their last record; of a circle the smallest id survives
_MERGES = """, nxt AS (SELECT x.id, x.merged_into AS onto FROM e x JOIN e y ON y.id = x.merged_into WHERE x.merged_into <> x.id),
walk(id, place, path) AS (SELECT id, onto, [id] FROM nxt UNION ALL SELECT w.id, n.onto, list_append(w.path, w.place) FROM walk w JOIN nxt n ON n.id = w.place WHERE NOT list_contains(w.path, w.place)),
fin AS (SELECT id, arg_max(place, len(path)) AS place, arg_max(path, len(path)) AS path FROM walk GROUP BY id),
mp0 AS (SELECT id AS absorbed_id, CASE WHEN list_contains(path, place) THEN list_min(path[list_position(path, place):]) ELSE place END AS survivor_id FROM fin),
mp AS (SELECT * FROM mp0 WHERE absorbed_id <> survivor_id)
"""


@query(_MERGES + """, u AS (SELECT survivor_id AS entity_id, name AS alias FROM mp JOIN e ON e.id = absorbed_id UNION SELECT survivor_id, alias FROM mp JOIN a ON a.entity_id = absorbed_id
UNION SELECT entity_id, alias FROM a WHERE entity_id IN (SELECT survivor_id FROM mp))
SELECT entity_id, alias FROM u JOIN e ON e.id = entity_id WHERE alias IS NOT NULL AND alias IS DISTINCT FROM name""")
def merge_entities_aliases(s, d):
    known = entities(s, d)
    return merging.merged_aliases(known, aliases(s, d), merging.merge_pairs(known))


@query(_MERGES + """, g AS (SELECT survivor_id, sum(access_count) AS n, max(last_seen) AS seen, min(created_at) AS made FROM mp JOIN e ON e.id = absorbed_id GROUP BY 1)
SELECT e.id, name, access_count + coalesce(n, 0) AS access_count, epoch_us(greatest(last_seen, seen)) AS last_seen_us, epoch_us(least(created_at, made)) AS created_us, archived OR mp.survivor_id IS NOT NULL AS archived,
CASE WHEN mp.survivor_id IS NOT NULL THEN mp.survivor_id WHEN EXISTS (SELECT 1 FROM mp z WHERE z.survivor_id = e.id AND z.absorbed_id = e.merged_into) THEN NULL ELSE merged_into END AS merged_into
FROM e LEFT JOIN g ON g.survivor_id = e.id LEFT JOIN mp ON mp.absorbed_id = e.id""")
def merge_entities_rows(s, d):
    known = entities(s, d)
    return merging.merged_entities(known, merging.merge_pairs(known)).select("id", "name", "access_count", micros("last_seen").alias("last_seen_us"), micros("created_at").alias("created_us"), "archived", "merged_into")


@query(_MERGES + """, mv AS (SELECT r.id, coalesce(x.survivor_id, source_id) AS source_id, coalesce(y.survivor_id, target_id) AS target_id, type, confidence, x.survivor_id IS NOT NULL OR y.survivor_id IS NOT NULL AS moved
  FROM r LEFT JOIN mp x ON x.absorbed_id = source_id LEFT JOIN mp y ON y.absorbed_id = target_id),
kept AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, type ORDER BY moved, id) AS n, max(CASE WHEN moved THEN confidence END) OVER (PARTITION BY source_id, target_id, type) AS best FROM mv WHERE NOT (moved AND source_id = target_id))
SELECT id, source_id, target_id, type, CASE WHEN n = 1 AND best > confidence THEN best ELSE confidence END AS confidence FROM kept WHERE NOT moved OR n = 1""")
def merge_entities_edges(s, d):
    return merging.merged_edges(relationships(s, d), merging.merge_pairs(entities(s, d))).select("id", "source_id", "target_id", "type", "confidence")


@query(_MERGES + """, h AS (SELECT entity_id, key, arg_max(id, (recorded_at, id)) AS held FROM p WHERE superseded_by_id IS NULL GROUP BY 1, 2)
SELECT p.id, coalesce(survivor_id, p.entity_id) AS entity_id, p.key, CASE WHEN survivor_id IS NOT NULL AND held IS NOT NULL THEN held ELSE superseded_by_id END AS superseded_by_id
FROM p LEFT JOIN mp ON absorbed_id = p.entity_id LEFT JOIN h ON h.entity_id = coalesce(survivor_id, p.entity_id) AND h.key = p.key""")
def merge_entities_properties(s, d):
    return merging.merged_properties(properties(s, d), merging.merge_pairs(entities(s, d))).select("id", "entity_id", "key", "superseded_by_id")


@query("""SELECT 'entities' AS table_name, count(*) AS n, 0 AS n_different FROM e UNION ALL SELECT 'aliases', count(*), 0 FROM a
UNION ALL SELECT 'properties', count(*), 0 FROM p UNION ALL SELECT 'relationships', count(*), 0 FROM r""")
def split_roundtrip(s, d):
    tables = {"entities": entities(s, d), "aliases": aliases(s, d), "properties": properties(s, d), "relationships": relationships(s, d)}
    back = merging.split(merging.merge(*tables.values(), merging.merge_pairs(tables["entities"]), at(NOW)))
    out = None
    for name, table in tables.items():
        hashed = F.xxhash64(*table.columns)
        same = table.select(hashed.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(back[name].select(hashed.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("m")), "h", "full")
        row = same.na.fill(0).agg(F.lit(name).alias("table_name"), F.sum("n").alias("n"), F.sum(F.abs(F.col("n") - F.col("m"))).alias("n_different"))
        out = row if out is None else out.unionByName(row)
    return out


_LOG = ", l AS (SELECT id, entity_id FROM access_log QUALIFY row_number() OVER (PARTITION BY id ORDER BY entity_id DESC NULLS LAST) = 1)\n"


def _counted(name: str, source: str) -> str:
    return f"(SELECT count(*) FROM {source} z WHERE z.entity_id = e.id) AS {name}"


@query(_LOG + f"""SELECT e.id AS entity_id, name, type, {_counted("aliases", "a")}, {_counted("properties", "p")}, {_counted("relationships", "(SELECT DISTINCT entity_id, id FROM sym)")},
{_counted("source_refs", "(SELECT entity_id, source_ref_id FROM p WHERE source_ref_id IN (SELECT id FROM s) UNION SELECT entity_id, source_ref_id FROM sym WHERE source_ref_id IN (SELECT id FROM s))")},
{_counted("access_log", "l")} FROM e""")
def export_entity(s, d):
    return privacy.export_counts(entities(s, d), aliases(s, d), properties(s, d), relationships(s, d), source_refs(s, d), access_log(s, d))


@query("SELECT p.id, entity_id, key, CASE WHEN conversation_id <> '' THEN concat_ws(':', conversation_id, turn_number) END AS source FROM p LEFT JOIN s ON s.id = p.source_ref_id")
def audit_belief(s, d):
    return privacy.audit_belief(properties(s, d), source_refs(s, d)).select("id", "entity_id", "key", "source")


@query(_LOG + f""", one AS (SELECT source_ref_id, min(entity_id) AS entity_id FROM p WHERE source_ref_id <> '' GROUP BY 1 HAVING count(DISTINCT entity_id) = 1)
SELECT e.id AS entity_id, {_counted("properties", "p")}, {_counted("relationships", "(SELECT DISTINCT entity_id, id FROM sym)")}, {_counted("aliases", "a")}, {_counted("source_refs", "one")}, {_counted("access_log", "l")}
FROM e WHERE type = 'person'""")
def hard_delete_counts(s, d):
    return privacy.deletion_counts(entities(s, d).where("type = 'person'"), aliases(s, d), properties(s, d), relationships(s, d), access_log(s, d))


@query("SELECT count(*) AS n FROM e WHERE type <> 'event' UNION ALL SELECT count(*) FROM p WHERE entity_id NOT IN (SELECT id FROM e WHERE type = 'event') UNION ALL SELECT count(*) FROM r WHERE source_id NOT IN (SELECT id FROM e WHERE type = 'event') AND target_id NOT IN (SELECT id FROM e WHERE type = 'event')")
def hard_delete(s, d):
    known = entities(s, d)
    tables = {"entities": known, "entity_aliases": aliases(s, d), "properties": properties(s, d), "relationships": relationships(s, d), "source_refs": source_refs(s, d)}
    left = privacy.hard_delete(known.where("type = 'event'"), tables)
    counts = [left[name].agg(F.count(F.lit(1)).alias("n")) for name in ("entities", "properties", "relationships")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(_CHUNKS + """SELECT chunk_id AS answer_id, trim(text) AS name, CASE WHEN lower(trim(participant)) IN ('person', 'organization', 'project', 'concept', 'location', 'event')
THEN lower(trim(participant)) ELSE 'concept' END AS type FROM c WHERE trim(text) <> ''""")
def parse_llm_json(s, d):
    rows = chunks(s, d).where("text <> ''").select(
        F.col("chunk_id").alias("answer_id"),
        F.concat(F.lit("```json\n["), F.to_json(F.struct(F.col("text").alias("name"), F.col("participant").alias("type"))), F.lit("]\n```")).alias("answer"),
    )
    return extraction.parse_entities(rows).select("answer_id", "name", "type")


@query(_CHUNKS + """SELECT chunk_id AS answer_id, trim(participant) AS source, trim(conversation_id) AS target, 'said_in' AS type FROM c WHERE trim(participant) <> '' AND trim(conversation_id) <> ''""")
def parse_llm_relations(s, d):
    told = chunks(s, d).where("participant is not null").select(F.col("chunk_id").alias("answer_id"), "participant", "conversation_id")
    said = F.to_json(F.array(F.struct(F.col("participant").alias("source"), F.col("conversation_id").alias("target"), F.lit(" Said In ").alias("type"))))
    names = told.select("answer_id", F.lit(0).alias("position"), F.trim("participant").alias("name"))
    return extraction.parse_relations(told.select("answer_id", F.concat(F.lit("Relations: "), said, F.lit(" as asked.")).alias("answer")), names).select("answer_id", "source", "target", "type")


def _turns(s, d):
    return chunks(s, d).where("conversation_id <> '' and text is not null").groupBy(F.col("conversation_id").alias("session"), F.col("turn_number").alias("turn")).agg(F.min("text").alias("text"))


# the SQL engine's word borders are ASCII, so other letters become digits, which no name or pronoun holds
_TURNS = _CHUNKS + ", turns AS (SELECT conversation_id AS session, turn_number AS turn, regexp_replace(min(text), '[^\\P{L}A-Za-z]', '0', 'g') AS text FROM c WHERE conversation_id <> '' AND text IS NOT NULL GROUP BY 1, 2)\n"
_NAMES = _TURNS + r""", n0 AS (SELECT session, turn, unnest(regexp_extract_all(text, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b', 1)) AS text, unnest(range(len(regexp_extract_all(text, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b', 1)))) AS position FROM turns),
n AS (SELECT session, turn, 0 AS phase, position, text, CASE WHEN regexp_matches(text, '\b(Corp|Inc|LLC|Ltd|Company|Group)\b') THEN 'organization' ELSE 'person' END AS type_hint, md5(session || '|' || lower(text)) AS id0
  FROM n0 WHERE len(regexp_split_to_array(text, '\s+')) <= 4),
o AS (SELECT session, turn, 1 AS phase, unnest(range(len(regexp_extract_all(text, '(?i)\b(he|him|his|she|her|they|them|their)\b', 1)))) AS position, unnest(regexp_extract_all(text, '(?i)\b(he|him|his|she|her|they|them|their)\b', 1)) AS text, 'person' AS type_hint, NULL AS id0 FROM turns),
b AS (SELECT * FROM n UNION ALL SELECT * FROM o),
m AS (SELECT session, turn, phase, position, text, type_hint, coalesce(id0, last_value(CASE WHEN phase = 0 AND type_hint = 'person' THEN id0 END IGNORE NULLS) OVER w, last_value(id0 IGNORE NULLS) OVER w) AS tentative_id
  FROM b WINDOW w AS (PARTITION BY session ORDER BY turn, phase, position ROWS UNBOUNDED PRECEDING))
"""


@query(_NAMES + "SELECT session, turn, position, text, type_hint, id0 AS tentative_id FROM n")
def session_mentions(s, d):
    return scratchpad.names(_turns(s, d)).drop("context")


@query(_NAMES + "SELECT session, tentative_id, text, turn, phase, position FROM m WHERE tentative_id IS NOT NULL")
def pronoun_coref(s, d):
    return scratchpad.mentions(_turns(s, d)).select("session", "tentative_id", "text", "turn", "phase", "position")


@query(_NAMES + "SELECT session, tentative_id, text AS best_name, type_hint FROM m WHERE tentative_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session, tentative_id ORDER BY len(text) DESC, turn, phase, position) = 1")
def unique_session_entities(s, d):
    return scratchpad.unique_entities(scratchpad.mentions(_turns(s, d)))


def _questions(s, d):
    return access_log(s, d).where("query is not null").select(F.col("query").alias("query_id"), F.col("query").alias("text")).distinct()


_LIKE = "list_bool_or(list_transform([{}], lambda p: contains(lower(query), p)))"
_ANY = lambda phrases: _LIKE.format(", ".join(f"'{p}'" for p in phrases))


@query(f"SELECT DISTINCT query, {_ANY(text.WIDE)} AS wide, CASE WHEN {_ANY(text.WIDE)} THEN 20 ELSE 10 END AS top_k, CASE WHEN {_ANY(text.WIDE)} THEN 10 ELSE 5 END AS max_conversations, {_ANY(text.SIMPLE)} AS simple FROM access_log WHERE query IS NOT NULL", clean=False)
def query_classification(s, d):
    wide = text.is_wide_question(F.col("text"))
    return _questions(s, d).select(F.col("text").alias("query"), wide.alias("wide"), F.when(wide, 20).otherwise(10).alias("top_k"), F.when(wide, 10).otherwise(5).alias("max_conversations"), text.is_simple_recall(F.col("text")).alias("simple"))


@query(f"SELECT DISTINCT query, {_ANY(text.COUNTING)} AND NOT {_ANY(text.NOT_COUNTING)} AS counting FROM (SELECT text AS query FROM verbatim_chunks WHERE text IS NOT NULL)", clean=False)
def counting_question(s, d):
    return chunks(s, d).where("text is not null").select(F.col("text").alias("query")).distinct().select("query", text.is_counting_question(F.col("query")).alias("counting"))


def _asked(s, d):
    return entities(s, d).where("name is not null").select(F.col("id").alias("query_id"), F.concat(F.lit("tell me about "), "name").alias("text"))


_IDENTIFY = """, q AS (SELECT id AS query_id, 'tell me about ' || name AS text FROM e WHERE name IS NOT NULL),
pr AS (SELECT query_id, 0 AS step, text AS probe FROM q UNION ALL SELECT query_id, step, w FROM (SELECT query_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS step FROM
  (SELECT query_id, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: len(w) > 2) AS ws FROM q))),
hit AS (SELECT query_id, entity_id, min(step) AS step FROM pr JOIN surfaces ON contains(lower(surface), lower(probe)) GROUP BY 1, 2),
found AS (SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY step, created_at, entity_id) AS place FROM hit JOIN e ON e.id = entity_id)
"""


@query(_IDENTIFY + "SELECT * FROM found")
def recall_identify(s, d):
    return recall.identify(_asked(s, d), entities(s, d), aliases(s, d))


_EXPAND = _IDENTIFY + """, act AS (SELECT id, name, type, confidence, created_at FROM e WHERE NOT archived),
held AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY key) AS item FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, key ORDER BY recorded_at DESC, id DESC) AS rn FROM p WHERE superseded_by_id IS NULL) WHERE rn = 1),
ed AS (SELECT sym.*, act.name AS other_name, row_number() OVER (PARTITION BY entity_id ORDER BY valid_from, sym.id) AS edge_no FROM sym JOIN act ON act.id = other_id WHERE sym.entity_id <> other_id OR direction = 'outgoing'),
facts AS (
  SELECT query_id, place, 0 AS part, 0 AS edge_no, 0 AS item, 'entity:' || entity_id AS fact_id, entity_id, NULL AS target_id, act.confidence, act.created_at AS recorded_at FROM found JOIN act ON act.id = entity_id
  UNION ALL SELECT query_id, place, 1, 0, item, 'prop:' || entity_id || ':' || key, entity_id, NULL, held.confidence, recorded_at FROM found JOIN held USING (entity_id) JOIN act ON act.id = entity_id
  UNION ALL SELECT query_id, place, 2, edge_no, 0, 'rel:' || ed.id, entity_id, other_id, ed.confidence, valid_from FROM found JOIN ed USING (entity_id)
  UNION ALL SELECT query_id, place, 2, edge_no, item, 'prop:' || other_id || ':' || held.key, other_id, NULL, held.confidence * 0.8, recorded_at FROM found JOIN ed USING (entity_id) JOIN held ON held.entity_id = other_id),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, fact_id ORDER BY place, part, edge_no, item) AS n FROM facts) WHERE n = 1 AND confidence > 0.05)
"""


@query(_EXPAND + "SELECT query_id, fact_id, entity_id, target_id, round(confidence, 9) AS confidence FROM once")
def recall_expand(s, d):
    found = recall.identify(_asked(s, d), entities(s, d), aliases(s, d))
    facts = recall.expand(found, entities(s, d), properties(s, d), relationships(s, d))
    return facts.select("query_id", "fact_id", "entity_id", "target_id", F.round("confidence", 9).alias("confidence"))


@query(_EXPAND + f"""SELECT query_id, fact_id, round(round(confidence * (0.4 * CASE WHEN x.entity_id IS NOT NULL THEN 1.0 WHEN y.entity_id IS NOT NULL THEN 0.8 ELSE 0.3 END
 + 0.3 * coalesce(exp(-greatest(0, {_DAYS.format("recorded_at")}) / 30.0), 0.5) + 0.3 * confidence), 9), 6) AS score
FROM once LEFT JOIN found x USING (query_id, entity_id) LEFT JOIN found y ON y.query_id = once.query_id AND y.entity_id = target_id""")
def recall_score(s, d):
    found = recall.identify(_asked(s, d), entities(s, d), aliases(s, d))
    facts = recall.expand(found, entities(s, d), properties(s, d), relationships(s, d))
    return recall.score(facts, found, at(NOW)).select("query_id", "fact_id", F.round("score", 6).alias("score"))


@query()
def recall_budgeted(s, d):
    found = recall.identify(_asked(s, d), entities(s, d), aliases(s, d))
    facts = recall.expand(found, entities(s, d), properties(s, d), relationships(s, d))
    return recall.select(recall.score(facts, found, at(NOW))).select("query_id", "taken", "fact_id", "cost")


@query()
def recall_text(s, d):
    return recall.recall(_asked(s, d), entities(s, d), aliases(s, d), properties(s, d), relationships(s, d), at(NOW))


@query()
def recall_with_raw_text(s, d):
    asked = _organizations(s, d)
    told = recall.raw_text(asked, chunks(s, d))
    return recall.recall(asked, entities(s, d), aliases(s, d), properties(s, d), relationships(s, d), at(NOW), verbatim=told)


@query()
def recall_as_of(s, d):
    return recall.recall(_asked(s, d), entities(s, d), aliases(s, d), properties(s, d), relationships(s, d), at(NOW), as_of=at("2025-01-01 00:00:00"), strict_as_of=True)


@query("""WITH r AS (SELECT coalesce(lang, '?') AS category, coalesce(align_score, 0) >= 0.5 AS ok FROM documents), b AS (SELECT category, count(*) AS n, count_if(ok) AS n_right, count_if(ok) / count(*) AS accuracy FROM r GROUP BY 1)
SELECT category, n, n_right, round(accuracy, 9) AS accuracy FROM b UNION ALL SELECT 'overall', sum(n), sum(n_right), round(sum(n_right) / sum(n), 9) FROM b
UNION ALL SELECT 'task_average', sum(n), sum(n_right), round(avg(accuracy), 9) FROM b""", clean=False)
def eval_accuracy(s, d):
    judged = scan(s, d, "documents").select(F.coalesce("lang", F.lit("?")).alias("lang"), (F.coalesce("align_score", F.lit(0.0)) >= 0.5).alias("ok"))
    return evaluation.accuracy(judged, "lang", "ok").withColumn("accuracy", F.round("accuracy", 9))


@query("""SELECT event_type, s[1 + CAST(round_even(0.5 * (n - 1), 0) AS INT)] AS p50, s[1 + CAST(round_even(0.95 * (n - 1), 0) AS INT)] AS p95, s[1 + CAST(round_even(0.99 * (n - 1), 0) AS INT)] AS p99, n, round(mean, 6) AS mean, s[1] AS least, s[n] AS most
FROM (SELECT event_type, list_sort(list(value)) AS s, count(value) AS n, avg(value) AS mean FROM events WHERE value IS NOT NULL GROUP BY 1)""", clean=False)
def latency_percentiles(s, d):
    return evaluation.nearest_rank(scan(s, d, "events", "event_type", "value"), "event_type", "value").withColumn("mean", F.round("mean", 6))


@query("SELECT doc_id, source FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) <= 20", clean=False)
def stratified_sample(s, d):
    return evaluation.stratified_sample(scan(s, d, "documents", "doc_id", "source").where("source is not null"), "source", "doc_id", 20)


_HOLDS = "(contains(lower({1}), trim(lower({0}))) OR coalesce(len(list_filter({2}, lambda w: contains(lower({1}), w))) / nullif(len({2}), 0), 0) > 0.7)"


@query(f"""WITH f AS (SELECT doc_id, align_score, target_text AS ref, text, list_filter(regexp_split_to_array(trim(lower(target_text)), '\\s+'), lambda w: len(w) > 3) AS ws FROM documents WHERE text IS NOT NULL AND target_text IS NOT NULL)
SELECT doc_id, CASE WHEN {_HOLDS.format("ref", "text", "ws")} AND {_HOLDS.format("ref", "source", "ws")} THEN 'JUDGE_DISAGREEMENT' WHEN {_HOLDS.format("ref", "text", "ws")} THEN 'ANSWER_ERROR' ELSE 'RETRIEVAL_MISS' END AS failure
FROM (SELECT f.*, coalesce(d.source, '') AS source FROM f JOIN documents d USING (doc_id))""", clean=False)
def failure_classification(s, d):
    rows = scan(s, d, "documents", "doc_id", "text", "target_text", "source").where("text is not null and target_text is not null")
    return rows.select("doc_id", evaluation.failure_class(F.col("target_text"), F.coalesce("source", F.lit("")), F.col("text")).alias("failure"))


@query(_CHUNKS + """SELECT chunk_id FROM (SELECT chunk_id, sum(coalesce(len(text), 0)) OVER (PARTITION BY conversation_id ORDER BY turn_number, chunk_id ROWS UNBOUNDED PRECEDING) AS chars FROM c WHERE conversation_id <> '') WHERE chars <= 400""")
def token_budget_prefix(s, d):
    return evaluation.prefix_within_budget(chunks(s, d).where("conversation_id <> ''"), "conversation_id", ["turn_number", "chunk_id"], "text", 100).select("chunk_id")


@query(_CHUNKS + """SELECT conversation_id, string_agg(x, chr(10) ORDER BY turn_number, x) AS session FROM (SELECT conversation_id, turn_number,
upper(substr(speaker_role, 1, 1)) || substr(speaker_role, 2) || ': ' || coalesce(text, '') AS x FROM c JOIN speaker_labels ON label = regexp_replace(lower(participant), '^\\s+|[\\s:]+$', '', 'g') WHERE conversation_id <> '') GROUP BY 1""")
def session_texts(s, d):
    labelled = chunks(s, d).where("conversation_id <> ''").withColumn("label", F.regexp_replace(F.lower("participant"), r"(?U)^\s+|[\s:]+$", ""))
    known = scan(s, d, "speaker_labels").select("label", F.col("speaker_role").alias("role"))
    return evaluation.session_text(labelled.join(F.broadcast(known), "label"))  # a fixed list of labels


_JUDGED = "SELECT coalesce(lang, '?') AS category, least(greatest(coalesce(align_score, 0), 0), 1) AS fact_recall, CASE WHEN text IS NOT NULL THEN 1.0 ELSE 0.0 END AS entity_recall FROM documents"


@query(f"""WITH j AS ({_JUDGED}) SELECT category, count(*) AS n, round(avg(entity_recall), 6) AS entity_recall, round(avg(fact_recall), 6) AS fact_recall FROM j GROUP BY 1
UNION ALL SELECT 'overall', count(*), round(avg(entity_recall), 6), round(avg(fact_recall), 6) FROM j""", clean=False)
def eval_recall_averages(s, d):
    bounded = F.least(F.greatest(F.coalesce("align_score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    judged = scan(s, d, "documents").select(F.coalesce("lang", F.lit("?")).alias("c"), F.col("text").isNotNull().cast("double").alias("entities"), bounded.alias("facts"))
    found = evaluation.recall_averages(judged, "c", "entities", "facts")
    return found.select("category", "n", F.round("entity_recall", 6).alias("entity_recall"), F.round("fact_recall", 6).alias("fact_recall"))


@query("WITH x AS (" + SQL["failure_classification"].replace("WITH f AS", "WITH f AS", 1) + """), k(failure) AS (VALUES ('RETRIEVAL_MISS'), ('ANSWER_ERROR'), ('JUDGE_DISAGREEMENT'))
SELECT failure, count(doc_id) AS n, round(100.0 * count(doc_id) / (SELECT count(*) FROM x), 6) AS share FROM k LEFT JOIN x USING (failure) GROUP BY 1""", clean=False)
def failure_counts(s, d):
    return evaluation.failure_counts(failure_classification(s, d)).select("failure", "n", F.round("share", 6).alias("share"))


@query("SELECT d.doc_id, d.source, m.mix_name, m.max_repeats FROM documents d JOIN (SELECT DISTINCT mix_name, source, max_repeats FROM mix_targets) m ON m.source = d.source", clean=False)
def eval_with_references(s, d):
    references = scan(s, d, "mix_targets", "mix_name", "source", "max_repeats").distinct()
    return evaluation.with_references(scan(s, d, "documents", "doc_id", "source"), references, "source").select("doc_id", "source", "mix_name", "max_repeats")


@query("SELECT count(*) > 1 AND count(conversation_id) = count(*) AND min(coalesce(conversation_id, '')) = max(coalesce(conversation_id, '')) AS shared FROM verbatim_chunks", clean=False)
def shared_haystack(s, d):
    return evaluation.shared_haystack(scan(s, d, "verbatim_chunks", "conversation_id"), "conversation_id")


@query("""SELECT entity_id, key, value_json AS value FROM p WHERE value_json IS NOT NULL AND as_of IS NOT NULL AND strftime(as_of, '%Y-%m') <= '2024-06'
QUALIFY row_number() OVER (PARTITION BY entity_id, key ORDER BY strftime(as_of, '%Y-%m') DESC, value_json DESC) = 1""")
def value_as_of_month(s, d):
    told = properties(s, d).where("value_json is not null and as_of is not null").withColumn("month", F.date_format("as_of", "yyyy-MM")).withColumn("asked", F.lit("2024-06"))
    return evaluation.value_as_of_month(told, ["entity_id", "key"], "month", "value_json", "asked")

