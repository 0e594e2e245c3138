"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

from marquetry.plans.views import EPISODES_SQL, IDS_SQL, RECORDS_SQL, STORED_SQL

UP, LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def low(x: str) -> str:
    return f"translate({x}, {UP}, {LOW})"


def up(x: str) -> str:
    return f"translate({x}, {LOW}, {UP})"


SQL: dict[str, str] = {}

_TOKENS = r"list_filter(string_split_regex(strip_accents(lower(substr(text, 1, 60))) || ' ' || strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _bm25(terms: list[str]) -> str:
    """CTEs up to ``hits``: rows that have all terms, with their scores."""
    match = lambda t: f"starts_with(x, '{t}')" if len(t) > 1 else f"x = '{t}'"
    tfs = ", ".join(f"len(list_filter(toks, lambda x: {match(t)})) AS tf{i}" for i, t in enumerate(terms))
    ns = ", ".join(f"count(*) FILTER (tf{i} > 0) AS n{i}" for i in range(len(terms)))
    every = " AND ".join(f"tf{i} > 0" for i in range(len(terms)))
    idf = lambda i: f"(CASE WHEN ln((n - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)) END)"
    part = lambda i: f"{idf(i)} * (tf{i} * 2.2::DOUBLE) / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"
    score = " + ".join(part(i) for i in range(len(terms)))
    return f"""t AS (SELECT doc_id AS media_id, lang AS media_kind, source AS format, substr(text, 1, 60) AS title_display, {_TOKENS} AS toks FROM documents),
f AS (SELECT * EXCLUDE (toks), len(toks) AS dl, {tfs} FROM t),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {ns} FROM f),
hits AS (SELECT f.*, {score} AS s FROM f, st WHERE {every})"""


def _search(terms: list[str], where: str = "true", limit: int = 20, offset: int = 0) -> str:
    return f"WITH {_bm25(terms)} SELECT media_id, media_kind, title_display, round(s, 9) AS score FROM hits WHERE {where} ORDER BY s DESC, media_id LIMIT {limit} OFFSET {offset}"


SQL["bm25_search"] = _search(["the", "of"])
SQL["bm25_search_kind"] = _search(["ea"], "media_kind = 'fr'")
SQL["bm25_search_format"] = _search(["the", "of"], f"{up('coalesce(format, chr(32))')} = 'SRC3'")
SQL["bm25_search_kind_format"] = _search(["the", "of"], f"media_kind = 'en' AND {up('format')} = 'SRC1'")
SQL["bm25_search_page2"] = _search(["the", "of"], limit=10, offset=10)
SQL["bm25_all"] = f"WITH {_bm25(['ea', 'the'])} SELECT media_id, round(s, 9) AS score FROM hits"
SQL["bm25_postings"] = SQL["bm25_all"]
SQL["token_postings"] = f"WITH t AS (SELECT doc_id AS media_id, {_TOKENS} AS toks FROM documents), x AS (SELECT media_id, len(toks)::INT AS dl, unnest(toks) AS token FROM t) SELECT media_id, token, count(*)::BIGINT AS tf, any_value(dl)::INT AS dl FROM x GROUP BY media_id, token"

# Scores of fields, as text over the columns of the candidate view.
_LEN = lambda v: f"length(trim({v}, {WS}))"
_COMPLETE = lambda v: f"least(greatest({_LEN(v)} / 240.0::DOUBLE, 0.05::DOUBLE), 1.0::DOUBLE)"


def _quality(v: str, synopsis: bool) -> str:
    base = f"least(greatest({_LEN(v)} / 600.0::DOUBLE, 0.15::DOUBLE), 1.0::DOUBLE)" if synopsis else f"least(greatest({_LEN(v)} / 80.0::DOUBLE, 0.20::DOUBLE), 1.0::DOUBLE)"
    t = f"trim({v}, {WS})"
    return f"(CASE WHEN {t} = '' THEN 0::DOUBLE ELSE least(greatest({base} + CASE WHEN contains({t}, chr(10)) THEN 0.10::DOUBLE ELSE 0::DOUBLE END - CASE WHEN contains({t}, '<') OR contains({t}, '>') THEN 0.15::DOUBLE ELSE 0::DOUBLE END, 0::DOUBLE), 1::DOUBLE) END)"


def _cover(v: str) -> str:
    u = low(v)
    return f"least(0.35::DOUBLE + CASE WHEN contains({u}, 'large') OR contains({u}, 'extra') OR contains({u}, 'original') THEN 0.35::DOUBLE ELSE 0::DOUBLE END + CASE WHEN ends_with({u}, '.webp') THEN 0.15::DOUBLE ELSE 0::DOUBLE END + CASE WHEN starts_with({u}, 'https://') THEN 0.15::DOUBLE ELSE 0::DOUBLE END, 1::DOUBLE)"


def _score(field: str) -> str:
    if field in ("season_year", "episodes"):
        return f"weight * 0.25::DOUBLE + CASE WHEN {field} > 0 THEN 0.20::DOUBLE ELSE 0::DOUBLE END + CASE WHEN {field} > 1 THEN 0.30::DOUBLE ELSE 0.10::DOUBLE END + bonus * 0.25::DOUBLE"
    if field == "cover_image":
        return f"weight * 0.20::DOUBLE + {_COMPLETE(field)} * 0.10::DOUBLE + {_cover(field)} * 0.45::DOUBLE + bonus * 0.15::DOUBLE + least(greatest(coalesce(provider_rating, 0::DOUBLE), 0::DOUBLE), 1::DOUBLE) * 0.10::DOUBLE"
    if field == "nsfw":
        return "weight * 0.30::DOUBLE + CASE WHEN nsfw THEN 0.35::DOUBLE ELSE 0.20::DOUBLE END + bonus * 0.35::DOUBLE"
    return f"weight * 0.25::DOUBLE + {_COMPLETE(field)} * 0.20::DOUBLE + {_quality(field, field == 'synopsis')} * 0.35::DOUBLE + bonus * 0.20::DOUBLE"


def _winner(field: str) -> str:
    """A CTE with the winner of a field for each entity."""
    return f"""w_{field} AS (SELECT entity, {field} AS v, s, src, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY s DESC, seq DESC) AS rn FROM (SELECT *, {_score(field)} AS s FROM c WHERE {field} IS NOT NULL)) WHERE rn = 1)"""


_ENTITIES = "e AS (SELECT DISTINCT entity FROM c)"


def _winners(fields: tuple[str, ...]) -> str:
    cols = ", ".join(f"w_{f}.v AS {f}, round(w_{f}.s, 6) AS {f}_score, w_{f}.src AS {f}_source" for f in fields)
    joins = " ".join(f"LEFT JOIN w_{f} ON w_{f}.entity = e.entity" for f in fields)
    return f"WITH {RECORDS_SQL}, {_ENTITIES}, {', '.join(map(_winner, fields))} SELECT e.entity, {cols} FROM e {joins}"


SQL["scored_merge_text"] = _winners(("title_display", "title_english", "synopsis"))
SQL["scored_merge_int"] = _winners(("season_year", "episodes"))
SQL["scored_merge_cover"] = _winners(("cover_image",))
SQL["scored_merge_bool"] = _winners(("nsfw",))
SQL["merge_rating_max"] = f"WITH {RECORDS_SQL} SELECT entity, max(provider_rating) AS provider_rating FROM c GROUP BY entity"
SQL["merge_first_kind"] = f"WITH {RECORDS_SQL} SELECT entity, arg_min(media_kind, seq) AS media_kind FROM c GROUP BY entity"
_FILLED = ("title_display", "title_romaji", "title_english", "synopsis", "format", "season_year", "episodes", "cover_image", "nsfw")
SQL["merge_provenance"] = f"WITH {RECORDS_SQL}, {', '.join(map(_winner, _FILLED))} " + " UNION ALL ".join(f"SELECT entity, '{f}' AS field_name, src AS source, seq::VARCHAR AS source_id, round(s, 6) AS score FROM w_{f}" for f in _FILLED)
SQL["merge_upsert_stored"] = f"""WITH {RECORDS_SQL}, {_ENTITIES}, {', '.join(map(_winner, ('synopsis', 'episodes', 'nsfw')))},
a AS (SELECT entity, arg_min(media_kind, seq) AS media_kind, max(provider_rating) AS provider_rating FROM c GROUP BY entity)
SELECT a.entity, a.media_kind, a.provider_rating, s.v AS synopsis, round(s.s, 6) AS synopsis_score, p.v AS episodes, n.v AS nsfw
FROM a LEFT JOIN w_synopsis s USING (entity) LEFT JOIN w_episodes p USING (entity) LEFT JOIN w_nsfw n USING (entity)"""
_ALIASES = f"""al AS (SELECT doc_id // 5 AS entity, doc_id AS seq, unnest([substr(text, 1, 12), source, upper(source)]) AS v, unnest([0, 1, 2]) AS pos FROM documents)"""
SQL["ordered_ci_union"] = f"""WITH {_ALIASES}, k AS (SELECT entity, {low('v')} AS k, min((seq, pos, v)) AS m FROM al GROUP BY entity, {low('v')})
SELECT entity, string_agg(m[3], '|' ORDER BY m[1], m[2]) AS aliases FROM k GROUP BY entity"""
_NORM = lambda v: rf"array_to_string(list_filter(string_split_regex(regexp_replace({low(v)}, '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda x: x <> ''), ' ')"
SQL["alias_union"] = f"""WITH {_ALIASES}, tr AS (SELECT entity, seq, pos, trim(v, {WS}) AS alias FROM al),
k AS (SELECT entity, min((seq, pos, alias)) AS m FROM tr WHERE alias <> '' GROUP BY entity, {low('alias')}),
n AS (SELECT entity, m[1] AS seq, m[2] AS pos, m[3] AS alias, {_NORM('m[3]')} AS normalized_alias FROM k)
SELECT entity, alias, normalized_alias FROM n QUALIFY row_number() OVER (PARTITION BY entity, normalized_alias ORDER BY seq, pos) = 1"""
_EV = "SELECT user_id, event_type, event_id, props FROM events"
_KEYED = "QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {}) = 1"
SQL["external_id_first_wins"] = f"{_EV} {_KEYED.format('')}"
SQL["payload_last_wins"] = f"{_EV} {_KEYED.format('DESC')}"
SQL["stream_replay"] = SQL["payload_last_wins"]
SQL["stream_winners"] = SQL["merge_provenance"]
SQL["merged_external_ids"] = f"WITH {RECORDS_SQL} SELECT entity, media_kind, src AS source, seq::VARCHAR AS source_id FROM c"
SQL["merged_payloads"] = f"""WITH {RECORDS_SQL} SELECT entity, src AS source, seq::VARCHAR AS source_id, '{{"n":' || n_chars || '}}' AS raw_json, strlen('{{"n":' || n_chars || '}}')::VARCHAR AS payload_hash FROM c"""
_COMES = "(event_id % 2 = 1 AND event_type <> 'click' OR event_type = 'view')"
SQL["upsert_full_outer"] = f"""WITH o AS ({_EV} WHERE NOT {_COMES} {_KEYED.format('DESC')}), n AS ({_EV} WHERE {_COMES} {_KEYED.format('DESC')})
SELECT user_id, event_type, CASE WHEN n.event_id IS NULL THEN o.event_id ELSE n.event_id END AS event_id, CASE WHEN n.event_id IS NULL THEN o.props ELSE n.props END AS props
FROM o FULL OUTER JOIN n USING (user_id, event_type)"""
SQL["replace_children"] = """WITH n AS (SELECT l_orderkey, l_linenumber, l_quantity + 1 AS l_quantity FROM lineitem WHERE l_orderkey % 10 = 0 AND l_linenumber <= 2)
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM n) UNION ALL SELECT * FROM n"""

_KEY = "CASE WHEN absolute_number IS NOT NULL THEN 'abs:' || absolute_number ELSE 'se:' || coalesce(season_number, 0) || ':' || coalesce(episode_number, 0) END"
_BEST = lambda f, by: f"(arg_max({f}, rank * 1000000000000 + seq) FILTER ({f} IS NOT NULL)) AS {f}"
_LOWEST = lambda f: f"(list({f} ORDER BY rank, seq))[1] AS {f}"
_CATALOG = f"""WITH {EPISODES_SQL}, k AS (SELECT *, {_KEY} AS episode_key FROM ep), m AS (
SELECT media_id, episode_key, {', '.join(_LOWEST(f) for f in ('season_number', 'episode_number', 'absolute_number'))}, {_BEST('title_display', '')}, {_LOWEST('titles_json')},
{', '.join(_BEST(f, '') for f in ('synopsis', 'air_date', 'runtime_minutes'))} FROM k GROUP BY media_id, episode_key)"""
SQL["episode_merge_catalog"] = f"{_CATALOG} SELECT * FROM m"
SQL["episode_merge_effective"] = f"""WITH {EPISODES_SQL}, k AS (SELECT *, coalesce(absolute_number, episode_number) AS number FROM ep)
SELECT media_id, number, arg_max(source, rank * 1000000000000 + seq) AS source, arg_max(source_id, rank * 1000000000000 + seq) AS source_id,
{', '.join(_BEST(f, '') for f in ('episode_number', 'absolute_number', 'title_display', 'synopsis', 'air_date', 'runtime_minutes'))} FROM k WHERE number IS NOT NULL GROUP BY media_id, number"""
SQL["episode_back_reference"] = f"WITH {EPISODES_SQL} SELECT media_id, source, source_id, {_KEY} AS episode_key FROM ep"
SQL["episode_lookup_abs"] = f"{_CATALOG} SELECT media_id, episode_key, title_display FROM m WHERE media_id = 7 AND absolute_number = 5"
SQL["episode_lookup_se"] = f"{_CATALOG} SELECT media_id, episode_key, title_display FROM m WHERE media_id = 1 AND season_number = 1 AND episode_number = 2"
SQL["episode_order"] = f"{_CATALOG} SELECT episode_key, season_number, episode_number, absolute_number FROM m WHERE media_id = 7"
SQL["source_episode_order"] = f"WITH {EPISODES_SQL} SELECT source, source_id, absolute_number FROM ep WHERE media_id = 7"
SQL["document_nest"] = "SELECT conv_id AS media_id, count(*)::INT AS n_episodes, string_agg(turn || ':' || role, ',' ORDER BY turn) AS episodes FROM conversations GROUP BY conv_id"
SQL["media_children_nest"] = """WITH l AS (SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey::VARCHAR) AS parts FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, o_orderstatus, coalesce(parts, '') AS parts FROM orders LEFT JOIN l ON l_orderkey = o_orderkey"""

_MET = f"WITH {IDS_SQL}, {STORED_SQL}, met AS (SELECT seq, pos, media_id FROM ids JOIN stored USING (source, source_id))"
SQL["identity_resolve"] = f"{_MET} SELECT seq, min((pos, media_id))[2] AS media_id FROM met GROUP BY seq"
SQL["identity_conflicts"] = f"{_MET} SELECT seq, count(DISTINCT media_id) AS n_media FROM met GROUP BY seq HAVING count(DISTINCT media_id) > 1"
SQL["identity_components"] = f"""WITH RECURSIVE {IDS_SQL}, p AS (SELECT DISTINCT a.seq AS x, b.seq AS y FROM ids a JOIN ids b USING (source, source_id)),
r AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON p.x = r.y) SELECT x AS seq, min(y) AS component FROM r GROUP BY x"""
#: Records of each component one after another; what is owned and held so far goes along as maps.
SQL["identity_replay"] = f"""WITH RECURSIVE {IDS_SQL}, p AS (SELECT DISTINCT a.seq AS x, b.seq AS y FROM ids a JOIN ids b USING (source, source_id)),
r AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON p.x = r.y), c AS (SELECT x AS seq, min(y) AS component FROM r GROUP BY x),
l AS (SELECT ids.seq, component, list(source || ':' || source_id ORDER BY pos) AS own, list(source ORDER BY pos) AS of FROM ids JOIN c ON c.seq = ids.seq GROUP BY ids.seq, component),
k AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY seq) AS k FROM l),
s AS (SELECT component, 0::BIGINT AS k, MAP {{}}::MAP(VARCHAR, BIGINT) AS owner, MAP {{}}::MAP(VARCHAR, VARCHAR) AS held, NULL::BIGINT AS seq, NULL::BIGINT AS media_id, NULL::VARCHAR AS status FROM k WHERE k = 1
  UNION ALL
  SELECT component, k,
         CASE WHEN status IN ('inserted', 'updated') THEN map_concat(owner, map_from_entries(list_transform(list_distinct(own), lambda x: row(x, media)))) ELSE owner END,
         CASE WHEN status IN ('inserted', 'updated') THEN map_concat(held, map_from_entries(list_transform(range(1, len(own) + 1), lambda i: row(media || ':' || of[i], own[i])))) ELSE held END,
         seq, CASE WHEN status IN ('inserted', 'updated') THEN media END, status
  FROM (SELECT *, CASE WHEN n > 1 THEN 'conflict'
                       WHEN len(list_distinct(of)) <> len(list_distinct(own)) OR len(list_filter(range(1, len(own) + 1), lambda i: coalesce(held[media || ':' || of[i]] <> own[i], false))) > 0 THEN 'duplicate_source'
                       WHEN n > 0 THEN 'updated' ELSE 'inserted' END AS status
        FROM (SELECT k.component, k.k, k.seq, k.own, k.of, s.owner, s.held, len(list_distinct(list_filter(list_transform(k.own, lambda x: s.owner[x]), lambda x: x IS NOT NULL))) AS n,
                     coalesce(list_filter(list_transform(k.own, lambda x: s.owner[x]), lambda x: x IS NOT NULL)[1], k.seq) AS media
              FROM s JOIN k ON k.component = s.component AND k.k = s.k + 1)))
SELECT seq, media_id, status FROM s WHERE k > 0"""
#: The same replay of records that have a title, and those that were taken as the merge's records, by media.
_TITLED = "ids AS (SELECT i.* FROM all_ids i JOIN documents d ON d.doc_id = i.seq WHERE d.doc_id % 7 <> 0 AND regexp_matches(substr(d.text, 1, 60), '\\S'))"
_REPLAYED = SQL["identity_replay"].removeprefix("WITH RECURSIVE ").replace("\nids AS (", "\nall_ids AS (", 1).replace(", p AS (", f", {_TITLED}, p AS (", 1)
_TAKEN = _REPLAYED.replace(", c AS (", ", comp AS (").replace(" JOIN c ON c.seq", " JOIN comp c ON c.seq").rsplit("SELECT seq, media_id", 1)[0]
_OF_MEDIA = RECORDS_SQL.replace("\nc AS (", "\nc0 AS (", 1) + ", c AS (SELECT c0.* EXCLUDE (entity), s.media_id AS entity FROM c0 JOIN s ON s.seq = c0.seq WHERE s.media_id IS NOT NULL)"
_MEDIA_FIELDS = ("title_display", "title_english", "synopsis", "season_year", "episodes", "nsfw")
SQL["catalog_ingest"] = f"""WITH RECURSIVE {_TAKEN}, {_OF_MEDIA}, e AS (SELECT entity, max(provider_rating) AS provider_rating FROM c GROUP BY entity), {', '.join(map(_winner, _MEDIA_FIELDS))}
SELECT e.entity AS media_id, e.provider_rating, {', '.join(f"{'md5(w_synopsis.v)' if f == 'synopsis' else f'w_{f}.v'} AS {f}" for f in _MEDIA_FIELDS)}
FROM e {' '.join(f'LEFT JOIN w_{f} ON w_{f}.entity = e.entity' for f in _MEDIA_FIELDS)}"""
SQL["catalog_delete"] = f"""WITH RECURSIVE {_TAKEN} SELECT DISTINCT s.media_id, ids.source, ids.source_id FROM ids JOIN s ON s.seq = ids.seq WHERE s.media_id % 3 <> 0"""
SQL["ambiguous_external_id"] = f"WITH {IDS_SQL}, {STORED_SQL} SELECT source, source_id, count(DISTINCT media_id) AS n_media FROM stored GROUP BY source, source_id HAVING count(DISTINCT media_id) > 1"
SQL["second_source_ids"] = f"WITH {IDS_SQL}, {STORED_SQL} SELECT media_id, source, count(DISTINCT source_id) AS n_ids FROM stored GROUP BY media_id, source HAVING count(DISTINCT source_id) > 1"
SQL["unique_lookup"] = f"WITH {IDS_SQL}, {STORED_SQL} SELECT DISTINCT media_id FROM stored WHERE source = 'anilist' AND source_id = 'a6'"
SQL["left_join_ratings"] = "SELECT doc_id, CASE WHEN quality IS NOT NULL THEN least(greatest((quality * 7 + n_chars % 5)::DOUBLE / 10, 0), 1) END AS provider_rating FROM documents LEFT JOIN labels USING (doc_id)"
SQL["semi_join_parents"] = "SELECT l_orderkey AS o_orderkey, l_linenumber, l_quantity FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')"
SQL["hash_join_episode"] = "SELECT l_orderkey, l_linenumber, p_partkey, p_name, CASE WHEN p_size - 25 > 0 THEN p_size - 25 END AS size_over FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45"
SQL["json_key_join"] = "SELECT event_id, s_suppkey, s_name FROM events JOIN supplier ON s_suppkey = TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"
SQL["included_lookup"] = "SELECT l_orderkey, string_agg(s_name, ',' ORDER BY l_linenumber, s_name) AS names FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey"
_SAME = " AND ".join(f"coalesce(a.{n}, 0) = coalesce(b.{n}, 0)" for n in ("season_number", "episode_number", "absolute_number"))
SQL["coalesced_key_join"] = f"WITH {EPISODES_SQL} SELECT a.seq AS a_seq, b.seq AS b_seq FROM ep a JOIN ep b ON a.media_id = b.media_id AND {_SAME} WHERE a.seq % 2 = 0 AND b.seq % 2 = 1"
SQL["multi_source_entities"] = "SELECT user_id, count(DISTINCT event_type) AS n_sources, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 2"
SQL["rows_by_source"] = "SELECT source, count(*) AS n_rows, count(DISTINCT lang) AS n_kinds FROM documents GROUP BY source"
SQL["rows_with_payload"] = "SELECT count(*) AS n_rows, count(*) FILTER (contains(props, '1')) AS n_ones, count(DISTINCT user_id) AS n_entities, sum(strlen(props))::BIGINT AS n_bytes FROM events"
SQL["distinct_media"] = "SELECT DISTINCT user_id AS media_id FROM events"
_MEDIA = "SELECT doc_id AS media_id, lang AS media_kind, source AS format, substr(text, 1, 60) AS title_display FROM documents"
SQL["point_lookup"] = f"SELECT media_id, media_kind, title_display FROM ({_MEDIA}) WHERE media_id = 42"
SQL["kind_fallback_lookup"] = f"SELECT media_id, media_kind FROM ({_MEDIA}) WHERE media_id % 100 = 17 AND media_kind IN ('es', 'en') ORDER BY CASE media_kind WHEN 'es' THEN 0 ELSE 1 END, media_id LIMIT 1"
SQL["collection_filter"] = f"SELECT media_id, format FROM ({_MEDIA}) WHERE media_kind = 'en' AND {up('format')} = 'SRC7'"
SQL["paged_scan"] = f"SELECT media_id, media_kind FROM ({_MEDIA}) ORDER BY media_id LIMIT 50 OFFSET 100"
SQL["limit_then_filter"] = f"SELECT media_id, format FROM (SELECT * FROM ({_MEDIA}) ORDER BY media_id LIMIT 50) WHERE {up('format')} = 'SRC1'"
SQL["substring_search"] = f"SELECT p_partkey, p_name FROM part WHERE contains({low('p_name')}, 're') ORDER BY p_partkey LIMIT 25"
SQL["trending_topk"] = "SELECT l_partkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_partkey ORDER BY quantity DESC, l_partkey LIMIT 50"
SQL["recommendations_explode"] = "SELECT l_partkey AS node, count(*) AS n FROM lineitem WHERE l_linenumber > 1 GROUP BY l_partkey"
SQL["related_flatten"] = "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_returnflag, l_partkey) AS related FROM lineitem GROUP BY l_orderkey"
SQL["kind_map"] = "SELECT * FROM (SELECT p_partkey, CASE WHEN p_partkey % 8 < 3 THEN 'movie' WHEN p_partkey % 8 < 6 THEN 'show' END AS kind FROM part) WHERE kind IS NOT NULL"
SQL["adult_flag"] = "SELECT p_partkey, p_partkey % 5 < 2 AND p_partkey % 11 <> 0 AS nsfw FROM part"
SQL["canonical_projection"] = f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN lang ELSE source END AS title_display,
{low('upper(source)')} AS season, (1950 + doc_id % 70)::INT AS season_year, 'https://www.imdb.com/title/tt' || doc_id AS url, '{{"doc_id":' || doc_id || ',"lang":"' || lang || '"}}' AS raw_json FROM documents"""
_STRIPPED = "html"
for _tag, _to in (("<p>", "''"), ("</p>", "''"), ("<br>", "chr(10)"), ("<br/>", "chr(10)"), ("<b>", "''"), ("</b>", "''"), ("<i>", "''"), ("</i>", "''")):
    _STRIPPED = f"replace({_STRIPPED}, '{_tag}', {_to})"
SQL["strip_html"] = f"SELECT page_id, trim({_STRIPPED}, {WS}) AS synopsis FROM pages"
SQL["normalize_lookup"] = f"SELECT doc_id, {_NORM('text')} AS normalized FROM documents"
SQL["text_scores"] = f"SELECT doc_id, round({_COMPLETE('text')}, 6) AS completeness, round({_quality('text', True)}, 6) AS synopsis_quality, round({_quality('text', False)}, 6) AS title_quality FROM documents"
SQL["cover_scores"] = f"WITH u AS (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '.webp' ELSE '/Extra' END AS u FROM pages) SELECT page_id, round({_cover('u')}, 6) AS quality FROM u"
SQL["consistency_scores"] = f"WITH {RECORDS_SQL} SELECT seq, round(bonus, 6) AS bonus FROM c"
SQL["source_weights"] = f"WITH {EPISODES_SQL} SELECT source, MAP {{'anilist': 0.9, 'jikan': 0.76, 'kitsu': 0.78, 'tvmaze': 0.82, 'imdb': 0.85}}[source]::DOUBLE AS weight, max(rank)::INT AS rank FROM ep GROUP BY source"
SQL["year_prefix"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN year(o_orderdate)::INT END AS year FROM orders"
SQL["null_marker"] = """SELECT event_id, CASE event_id % 4 WHEN 2 THEN event_id || 'x' WHEN 3 THEN event_id::VARCHAR END AS text_value, CASE WHEN event_id % 4 = 3 THEN event_id::INT END AS int_value,
CASE WHEN event_id % 4 = 3 AND event_id > 0 THEN event_id::INT END AS positive_value FROM events"""
SQL["payload_len"] = "SELECT doc_id, strlen(text)::VARCHAR AS payload_hash FROM documents"
SQL["first_token"] = r"SELECT doc_id, coalesce(list_filter(string_split_regex(text, '\s+'), lambda x: length(x) >= 3)[1], text) AS token FROM documents"
SQL["alias_list"] = f"""WITH a AS (SELECT p_partkey, unnest([p_brand, lower(p_brand), p_type, upper(p_type)]) AS v, unnest([1, 2, 3, 4]) AS i FROM part WHERE true),
k AS (SELECT p_partkey, min((i, v)) AS m FROM a GROUP BY p_partkey, {low('v')}) SELECT p_partkey, string_agg(m[2], ' ' ORDER BY m[1]) AS aliases FROM k GROUP BY p_partkey"""
SQL["union_skip_failures"] = "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')"
SQL["candidates"] = f"""WITH {EPISODES_SQL} SELECT media_id, CASE source WHEN 'jikan' THEN 'jikan' ELSE 'kitsu' END AS source, (seq % 20)::VARCHAR AS source_id, min(seq) AS pos
FROM ep WHERE source IN ('jikan', 'kitsu') GROUP BY 1, 2, 3"""
SQL["validate_domains"] = "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')"
SQL["validate_unique"] = "SELECT o_custkey, o_orderstatus, count(*) AS n_rows FROM orders GROUP BY o_custkey, o_orderstatus HAVING count(*) > 1"
SQL["validate_json"] = "SELECT event_id, props || '}' AS raw FROM events WHERE event_id % 10 = 0"
SQL["validate_records"] = """SELECT doc_id AS seq, CASE WHEN doc_id % 7 = 0 OR trim(substr(text, 1, 60)) = '' THEN 'title_display is empty' ELSE 'no external id' END AS reason
FROM documents WHERE doc_id % 7 = 0 OR doc_id % 17 = 0 OR trim(substr(text, 1, 60)) = ''"""
SQL["cascade_delete"] = "SELECT l_orderkey AS o_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)"
SQL["orphan_rows"] = "SELECT l_orderkey AS o_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)"
SQL["migration_copy"] = """SELECT o_orderkey, o_custkey, o_orderpriority, c_mktsegment AS segment FROM orders JOIN customer ON c_custkey = o_custkey
QUALIFY row_number() OVER (PARTITION BY c_mktsegment, o_orderpriority, o_custkey ORDER BY o_orderkey) = 1"""
SQL["sync_totals"] = "SELECT event_type, count(*) AS upserted, ceil(count(*) / 50.0)::BIGINT AS fetched_pages FROM events GROUP BY event_type"
