"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .spotsigs import ANCHORS, COMMON


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def sharding(n_shards: int) -> str:
    """The heap's picks one by one, in a recursive query."""
    key = "md5(coalesce(text, '') || chr(1) || CASE WHEN text IS NULL THEN 'true' ELSE 'false' END)"
    return f"""
WITH RECURSIVE rows AS (SELECT doc_id, {key} AS k, coalesce(strlen(text), 0) AS n FROM documents),
grp AS (SELECT k, CAST(sum(n) AS BIGINT) AS n FROM rows GROUP BY k),
o AS (SELECT k, n, row_number() OVER (ORDER BY n DESC, k) AS i FROM grp),
r AS (
  SELECT CAST(0 AS BIGINT) AS i, list_resize(CAST([] AS BIGINT[]), {n_shards}, CAST(0 AS BIGINT)) AS loads, CAST(NULL AS VARCHAR) AS k, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS pick
  UNION ALL
  SELECT o.i, list_transform(r.loads, lambda x, j: CASE WHEN j = list_position(r.loads, list_min(r.loads)) THEN x + o.n ELSE x END), o.k, o.n, CAST(list_position(r.loads, list_min(r.loads)) AS BIGINT)
  FROM r JOIN o ON o.i = r.i + 1)
SELECT doc_id, r.n AS group_size, CAST(r.pick - 1 AS INTEGER) AS shard FROM rows JOIN r ON rows.k = r.k"""


def _fingerprints() -> str:
    """f: doc_id, n and the sorted spots of every document that has any. rep: the classes."""
    upper = "".join(map(chr, range(65, 91)))
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
m AS (SELECT *, word IN ({_list(ANCHORS)}) AS anchor, word NOT IN ({_list(ANCHORS + COMMON)}) AS content FROM p),
c AS (SELECT doc_id, list(word ORDER BY pos) AS cs FROM m WHERE content GROUP BY doc_id),
a AS (SELECT doc_id, word, anchor, CAST(sum(CAST(content AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS before FROM m),
s AS (SELECT DISTINCT a.doc_id, a.word || ' ' || c.cs[a.before + 1] || ' ' || c.cs[a.before + 2] AS spot FROM a JOIN c ON a.doc_id = c.doc_id WHERE a.anchor AND a.before + 2 <= len(c.cs)),
f AS (SELECT doc_id, count(*) AS n, list(spot ORDER BY spot) AS spots FROM s GROUP BY doc_id),
rep AS (SELECT min(doc_id) AS id, any_value(n) AS n, spots FROM f GROUP BY spots)"""


def fingerprint_classes(threshold: float = 0.5) -> str:
    """Spots by words, all pairs of classes by a join on spots; equal texts where there is no spot."""
    return f"""{_fingerprints()},
e AS (SELECT id, n, unnest(spots) AS spot FROM rep),
j AS (SELECT x.id AS id_a, y.id AS id_b, CAST(count(*) AS DOUBLE) AS both_, any_value(x.n) + any_value(y.n) AS sizes FROM e x JOIN e y ON x.spot = y.spot AND x.id < y.id GROUP BY x.id, y.id),
k AS (SELECT id_a, id_b FROM j WHERE both_ / (sizes - both_) >= {threshold} - 1e-9),
l AS (SELECT id, count(*) AS links FROM (SELECT id_a AS id FROM k UNION ALL SELECT id_b AS id FROM k) t GROUP BY id)
SELECT f.doc_id, rep.id AS class_id, CAST(coalesce(l.links, 0) AS BIGINT) AS links FROM f JOIN rep ON f.spots = rep.spots LEFT JOIN l ON l.id = rep.id
UNION ALL SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, CAST(0 AS BIGINT) AS links FROM documents WHERE text <> '' AND doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM f WHERE doc_id IS NOT NULL)"""


def similar_vectors(threshold: float = 0.95) -> str:
    """Every pair of vectors by its cosine, and what each reaches over any chain of links."""
    return f"""
WITH RECURSIVE u AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding, b.embedding) >= {threshold}),
r AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
m AS (SELECT x, min(y) AS least FROM r GROUP BY x),
d AS (SELECT x, count(*) AS links FROM p GROUP BY x)
SELECT u.vec_id, least(u.vec_id, coalesce(m.least, u.vec_id)) AS class_id, CAST(coalesce(d.links, 0) AS BIGINT) AS links FROM u LEFT JOIN m ON m.x = u.vec_id LEFT JOIN d ON d.x = u.vec_id"""


def _fill(out: str, keys: list[str], weight: str, budget: str, parent: list[str], name: str) -> str:
    """Shares of the children (keys) of each parent, by water-filling: children fill up in order of capacity for each unit of weight.

    out: (keys, cap, share). budget: SQL of a parent's share, from table `name` joined on parent.
    """
    on = " AND ".join(f"c.{k} IS NOT DISTINCT FROM b.{k}" for k in parent) or "true"
    by = f"PARTITION BY {', '.join(parent)} " if parent else ""
    sel, ckeys = ", ".join(keys), ", ".join(f"c.{k}" for k in keys)
    return f"""
{out}_c AS (SELECT {sel}, CAST(sum(tok) * max_epochs AS DOUBLE) AS cap, CAST({weight} AS DOUBLE) AS w FROM leaf GROUP BY {sel}, max_epochs),
{out}_b AS (SELECT {ckeys}, c.cap, c.w, least({budget}, sum(c.cap) OVER ({by.replace('BY ', 'BY c.', 1).replace(', ', ', c.') if by else ''})) AS has FROM {out}_c c {'JOIN ' + name + ' b ON ' + on if name else ''} WHERE c.w > 0),
{out}_l AS (SELECT {sel}, cap, w, row_number() OVER o AS rn, (has - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {out}_b WINDOW o AS ({by}ORDER BY cap / w, {sel})),
{out} AS (SELECT {sel}, cap, CASE WHEN cap / w <= level + 1e-9 THEN cap ELSE w * arg_min(level, rn) FILTER (WHERE cap / w > level + 1e-9) OVER ({by}) END AS share FROM {out}_l)"""


def mixing(weights: dict[tuple, float], fraction: float = 0.5, max_epochs: int = 2, seed: int = 17) -> str:
    """Budgets by water-filling down domain, language and source, then prefixes of seeded epochs by running sums."""
    case = lambda depth, keys: "CASE " + " ".join("WHEN " + " AND ".join(f"{k} = '{v}'" for k, v in zip(keys, path, strict=True)) + f" THEN {w}" for path, w in weights.items() if len(path) == depth) + " ELSE 1 END"
    lev = ["domain", "lang", "source"]
    same = " AND ".join(f"t.{k} IS NOT DISTINCT FROM s.{k}" for k in lev)
    name = " || '/' || ".join(f"coalesce(t.{k}, '\\N')" for k in lev)
    return f"""
WITH d AS (SELECT doc_id, lang, source, TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 3 AS k, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS BIGINT) AS n FROM documents),
t AS (SELECT doc_id, CASE WHEN k = 0 THEN 'web' WHEN k = 1 THEN 'books' ELSE 'code' END AS domain, lang, source, n FROM d WHERE n > 0),
leaf AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS tok, {max_epochs} AS max_epochs FROM t GROUP BY domain, lang, source),
total AS (SELECT floor({fraction} * sum(tok)) AS budget FROM leaf),
{_fill("one", lev[:1], case(1, lev[:1]), "(SELECT budget FROM total)", [], "").lstrip()},
{_fill("two", lev[:2], case(2, lev[:2]), "b.share", lev[:1], "one").lstrip()},
{_fill("three", lev, "1", "b.share", lev[:2], "two").lstrip()},
s AS (SELECT three.domain, three.lang, three.source, CAST(floor(share + 1e-6) AS BIGINT) // tok AS full_, CAST(floor(share + 1e-6) AS BIGINT) % tok AS rest FROM three JOIN leaf t ON t.domain = three.domain AND t.lang IS NOT DISTINCT FROM three.lang AND t.source IS NOT DISTINCT FROM three.source),
j AS (SELECT t.doc_id, {name} AS leaf, t.n, s.full_, s.rest, md5('{seed}:' || s.full_ || ':' || coalesce(CAST(t.doc_id AS VARCHAR), '')) AS h FROM t JOIN s ON {same}),
w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY leaf ORDER BY h, doc_id NULLS FIRST, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM j)
SELECT doc_id, leaf, CAST(e AS INTEGER) AS epoch, n AS n_tokens, n AS take_tokens FROM (SELECT doc_id, leaf, n, unnest(range(full_)) AS e FROM j WHERE full_ > 0) x
UNION ALL SELECT doc_id, leaf, CAST(full_ AS INTEGER) AS epoch, n AS n_tokens, CAST(least(n, rest - at_) AS BIGINT) AS take_tokens FROM w WHERE at_ < rest"""
