"""DuckDB SQL of the operators that SQL can express."""

OP5_SQL = """
WITH RECURSIVE vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (SELECT * FROM vectors WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(v, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
 WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM vectors UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
found AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM found LEFT JOIN counts USING (vec_id)
"""

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH items AS (SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL) i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM items) i),
docs AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
grams AS (SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') AS g FROM
 (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM docs, (SELECT DISTINCT k FROM items) ks WHERE len(w) >= k) d),
hits AS (SELECT DISTINCT doc_id, s, k, item_id FROM grams JOIN windows USING (k, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) c GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP7_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[s : s + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM docs WHERE len(w) > 0) t),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) f LEFT JOIN sizes USING (doc_id)
"""

# targets: with the k sources of the lowest limit per weight closed, the others rise to one level; the
# first k whose level does not pass the next limit is the answer
OP9_SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
 CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight FROM sized GROUP BY source),
ranked AS (SELECT *, 2.0::DOUBLE * source_size AS top, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS k FROM sources),
levels AS (SELECT r.k, r.top / r.weight AS bound,
 (1.5::DOUBLE * (SELECT sum(source_size) FROM sources) - coalesce((SELECT sum(top) FROM ranked c WHERE c.k < r.k), 0)) / (SELECT sum(weight) FROM ranked o WHERE o.k >= r.k) AS level FROM ranked r),
chosen AS (SELECT level FROM levels WHERE level <= bound ORDER BY k LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN weight * (SELECT level FROM chosen) > top THEN top ELSE weight * (SELECT level FROM chosen) END AS target FROM ranked),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole FROM targets),
ordered AS (SELECT doc_id, size, source_size, target, whole, floor(target + 0.5)::BIGINT - whole * source_size AS rest,
 coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
 FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target,
 CAST(whole * size + greatest(0, least(size, rest - ahead)) AS BIGINT) AS taken FROM ordered
"""

_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents) d GROUP BY doc_id, term),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
items AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark) b GROUP BY item_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals WHERE term IN (SELECT term FROM items) GROUP BY term),
scores AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
 FROM tf JOIN items USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def _crc32(bytes_: str) -> str:
    """CRC-32 of a list of bytes by a table ``crc_table(t)``, whose entries follow from the polynomial."""
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_}), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295)"


# the polynomial is a fixed value of CRC-32
_CRC_TABLE = """crc_table AS (SELECT list(list_reduce([i] || range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
 FROM (SELECT unnest(range(256)) AS i) r)"""
_BYTES = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
_LETTERS = "coalesce(CAST('0x' || rpad(left(hex(encode({0})), 12), 12, '0') AS BIGINT), -1)"


def _op12_level(i: int) -> str:
    """Cuts the nodes of a level where the first half of their shards has its bytes."""
    width = lambda d: f"coalesce((max({d}) - min({d}))::DOUBLE / nullif(any_value(w_{d}), 0)::DOUBLE, 0)"
    return f"""
n{i} AS (SELECT node, k, sum(size) AS total, {width('d0')} AS p0, {width('d1')} AS p1, {width('d2')} AS p2 FROM t{i}, extent GROUP BY node, k),
o{i} AS (SELECT t.*, greatest(1, (2 * total * (k // 2)) // k) AS twice,
 CASE WHEN p0 >= p1 AND p0 >= p2 THEN d0 WHEN p1 >= p2 THEN d1 ELSE d2 END AS v FROM t{i} t JOIN n{i} USING (node, k)),
l{i} AS (SELECT *, 2 * sum(size) OVER (PARTITION BY node ORDER BY v, h, doc_id ROWS UNBOUNDED PRECEDING) - size <= twice AS low FROM o{i}),
t{i + 1} AS (SELECT doc_id, text, size, d0, d1, d2, h, CASE WHEN low THEN node ELSE node + k // 2 END AS node, CASE WHEN low THEN k // 2 ELSE k - k // 2 END AS k FROM l{i}),"""


OP12_SQL = f"""
WITH {_CRC_TABLE},
t0 AS (SELECT doc_id, text, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {_LETTERS.format('source')} AS d0, {_LETTERS.format('lang')} AS d1,
 CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS d2, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS h, 0 AS node, 8 AS k FROM documents),
extent AS (SELECT max(d0) - min(d0) AS w_d0, max(d1) - min(d1) AS w_d1, max(d2) - min(d2) AS w_d2 FROM t0),{''.join(map(_op12_level, range(3)))}
done AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY h, doc_id) - 1 AS slot FROM t3)
SELECT doc_id, size, CAST({_crc32(_BYTES.format("coalesce(text, '')"))} AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(node AS INT) AS shard, slot, CAST(NULL AS INT) AS grown_shard FROM done, crc_table
"""

_PART = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_TAMPERED = f"CASE WHEN {_crc32(_BYTES.format('CAST(doc_id AS VARCHAR)'))} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"


def _tree(nodes: str, name: str) -> str:
    """Levels of the trees over ``nodes(g, pos, digest)``, the paths of their leaves, and their roots."""
    return f"""
{name}_level AS (SELECT 0 AS l, g, pos, digest, count(*) OVER (PARTITION BY g) AS n FROM {nodes}
 UNION ALL SELECT l + 1, g, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 2) // 3) FROM {name}_level WHERE n > 1 GROUP BY l, g, pos // 3),
{name}_path AS (SELECT a.g, a.pos, x.l,
 coalesce((SELECT string_agg(y.digest, '' ORDER BY y.pos) FROM {name}_level y WHERE y.g = x.g AND y.l = x.l AND y.pos // 3 = x.pos // 3 AND y.pos < x.pos), '') AS lefts,
 coalesce((SELECT string_agg(y.digest, '' ORDER BY y.pos) FROM {name}_level y WHERE y.g = x.g AND y.l = x.l AND y.pos // 3 = x.pos // 3 AND y.pos > x.pos), '') AS rights
 FROM {nodes} a JOIN {name}_level x ON x.g = a.g AND x.n > 1 AND x.pos = a.pos // CAST(pow(3, x.l) AS BIGINT)),
{name}_paths AS (SELECT g, pos, list({{'lefts': lefts, 'rights': rights}} ORDER BY l) AS path FROM {name}_path GROUP BY g, pos),
{name}_root AS (SELECT g, digest AS root FROM {name}_level WHERE n = 1)"""


OP13_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
leaves AS (SELECT doc_id, source, sha256({' || '.join(_PART.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', 'text'))}) AS digest,
 sha256({' || '.join(_PART.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', f'({_TAMPERED})'))}) AS tampered FROM documents, crc_table),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos FROM leaves),{_tree('placed', 'low')},
tops AS (SELECT 0 AS g, g AS pos, root AS digest FROM low_root),{_tree('tops', 'high')},
found AS (SELECT p.*, s.root AS subroot, r.root AS root, list_concat(coalesce(a.path, []), coalesce(b.path, [])) AS path FROM placed p JOIN low_root s ON s.g = p.g CROSS JOIN high_root r
 LEFT JOIN low_paths a ON a.g = p.g AND a.pos = p.pos LEFT JOIN high_paths b ON b.pos = p.g),
folds AS (SELECT *, list_reduce(list_concat([{{'lefts': '', 'rights': tampered}}], path), lambda d, s: {{'lefts': '', 'rights': sha256(s.lefts || d.rights || s.rights)}}).rights AS folded_root FROM found)
SELECT doc_id, digest AS leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.lefts || s.rights), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folds
"""
