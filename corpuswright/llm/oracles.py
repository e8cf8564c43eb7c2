"""SQL twins of the registered queries that SQL can express."""

from __future__ import annotations

# The checksum's table is made by its rule: eight steps of shifting, the reversed polynomial
# added where a one leaves.
_CRC_TABLE = """crc_table AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS crc
    FROM (SELECT range AS i FROM range(256)))"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a text of code points below 2048; ``crc`` is in scope."""
    code_points = f"list_transform(string_split({text}, ''), lambda ch: unicode(ch)::BIGINT)"
    utf8 = f"flatten(list_transform({code_points}, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + p // 64, 128 + p % 64] END))"
    step = "xor(c // 256, crc[1 + (xor(c, b) & 255)])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {utf8}), lambda c, b: {step}), 4294967295)"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The distance function counts bytes, so each of the 64 other letters is given one byte.
_TWO_BYTES = "".join(chr(c) for c in range(0xC0, 0x100))
_ONE_BYTE = "".join(chr(c) for c in range(33, 127) if chr(c) not in _LOWER + "'")[:64]

SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
hashed AS (SELECT run, {_crc32("doc_id::VARCHAR || ':' || run")} AS h FROM runs, crc_table WHERE length(run) >= 6),
words AS (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word
    FROM hashed),
vocabulary AS (SELECT word, count(*) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
bytewise AS (SELECT *, translate(word, '{_TWO_BYTES}', '{_ONE_BYTE}') AS bytes FROM vocabulary),
near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS n_other
    FROM bytewise a JOIN bytewise b ON length(b.word) BETWEEN length(a.word) - 1 AND length(a.word) + 1 AND a.word <> b.word
        AND (substr(a.word, 1, length(a.word) // 2) = substr(b.word, 1, length(a.word) // 2)
            OR right(a.word, length(a.word) - length(a.word) // 2 - 1) = right(b.word, length(a.word) - length(a.word) // 2 - 1))
    WHERE levenshtein(a.bytes, b.bytes) = 1),
best AS (SELECT word, count(*) AS n_near, max(n_other) AS most FROM near GROUP BY word),
first_best AS (SELECT near.word, min(other) AS other FROM near JOIN best ON near.word = best.word AND n_other = most GROUP BY near.word),
forms AS (
    SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
        CASE WHEN most >= 5 * v.n THEN other END AS form, CASE WHEN most >= 5 * v.n THEN most END AS form_n
    FROM vocabulary v LEFT JOIN best USING (word) LEFT JOIN first_best USING (word)),
walk AS (
    SELECT word, form, coalesce(form, word) AS at, form IS NULL AS ended FROM forms
    UNION ALL
    SELECT walk.word, walk.form, coalesce(f.form, walk.at), f.form IS NULL FROM walk JOIN forms f ON f.word = walk.at WHERE NOT ended)
SELECT forms.word, forms.form, walk.at AS root, n, n_near, form_n FROM walk JOIN forms ON forms.word = walk.word WHERE ended
"""


def _field(column: str) -> str:
    text = f"({column})::VARCHAR"
    return f"coalesce(strlen({text})::VARCHAR || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, start: str, levels: int) -> str:
    """Levels of trees from ``start(tree, pos, node)``: parents and siblings of every node.
    Once a tree has one node its level stays as it is."""
    out = [f"{name}0 AS (SELECT tree, pos, node, count(*) OVER (PARTITION BY tree) AS size FROM {start})"]
    for i in range(levels):
        out.append(
            f"{name}{i + 1} AS (SELECT tree, pos // 16 AS pos, CASE WHEN any_value(size) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) "
            f"ELSE any_value(node) END AS node, (any_value(size) + 15) // 16 AS size FROM {name}{i} GROUP BY tree, pos // 16)"
        )
        out.append(
            f"{name}_flanks{i} AS (SELECT tree, pos, CASE WHEN size > 1 THEN coalesce(string_agg(node, '') OVER (PARTITION BY tree, pos // 16 ORDER BY pos "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l, CASE WHEN size > 1 THEN coalesce(string_agg(node, '') OVER "
            f"(PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r, size > 1 AS step FROM {name}{i})"
        )
    return ",\n".join(out)


def _merkle(levels: int) -> str:
    """``levels`` bounds the rows of a source and the number of sources to 16 to that power."""
    crc = _crc32("doc_id::VARCHAR")
    steps, joins, proof = [], [], []
    for tree, at in (("s", "leaves.source_key"), ("t", "''")):
        start = "leaves.pos" if tree == "s" else "subroots.pos"
        for i in range(levels):
            alias = f"{tree}f{i}"
            joins.append(f"JOIN {tree}_flanks{i} {alias} ON {alias}.tree = {at} AND {alias}.pos = {start} // {16 ** i}")
            steps.append(alias)
            proof += [f"{alias}.l", f"{alias}.r"]
    folds, before = [], "joined AS (SELECT leaves.*, subroots.node AS subroot, " + ", ".join(
        f"{a}.l AS {a}l, {a}.r AS {a}r, {a}.step AS {a}s" for a in steps
    ) + ", sha256(" + " || ".join(proof) + ") AS proof, coalesce(changed, leaf) AS h FROM leaves JOIN subroots ON subroots.tree_of = leaves.source_key " + " ".join(joins) + ")"
    folds.append(before)
    last = "joined"
    for i, a in enumerate(steps):
        folds.append(f"fold{i} AS (SELECT * REPLACE (CASE WHEN {a}s THEN sha256({a}l || h || {a}r) ELSE h END AS h) FROM {last})")
        last = f"fold{i}"
    return f"""
WITH {_CRC_TABLE},
leaves AS (
    SELECT doc_id, source_key, leaf, changed, row_number() OVER (PARTITION BY source_key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
    FROM (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS source_key, {_leaf("text")} AS leaf,
            CASE WHEN {crc} % 5 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS changed
        FROM documents, crc_table)),
s_start AS (SELECT source_key AS tree, pos, leaf AS node FROM leaves),
{_tree("s", "s_start", levels)},
subroots AS (SELECT tree AS tree_of, node, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM s{levels}),
t_start AS (SELECT '' AS tree, pos, node FROM subroots),
{_tree("t", "t_start", levels)},
root AS (SELECT node AS root FROM t{levels}),
{(","+chr(10)).join(folds)}
SELECT doc_id, leaf, subroot, root, proof AS proof_sha256, h AS folded_root, h = root AS verified FROM {last}, root
"""


SEARCH = """
WITH rows AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v)::BIGINT AS score
    FROM rows q JOIN rows r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_WORDS = r"[^\x20\x09-\x0D]+"


def _components(nodes: str, links: str) -> str:
    """``named(node, component)`` from tables of one column ``node`` and of two, ``a, b``, both ways."""
    return f"""reach(node, goal) AS (
    SELECT node, node FROM {nodes}
    UNION
    SELECT reach.node, l.b FROM reach JOIN {links} l ON l.a = reach.goal),
named AS (SELECT node, min(goal) AS component FROM reach GROUP BY node)"""


NEAR_COPIES = f"""
WITH RECURSIVE texts AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORDS}'), []) AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
        ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM texts),
sizes AS (SELECT doc_id AS node, len(s) AS n FROM sets),
members AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (
    SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM members p JOIN members q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM common JOIN sizes x ON x.node = a JOIN sizes y ON y.node = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
{_components("sizes", "links")}
SELECT node AS doc_id, n AS n_shingles, component AS component_id, node = component AS kept FROM sizes JOIN named USING (node)
"""

PASSAGES = f"""
WITH texts AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORDS}'), []) AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM texts),
windows AS (
    SELECT doc_id, place, word, CASE WHEN lead(place, 19) OVER ahead IS NOT NULL
        THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS seen
    FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY place)),
repeated AS (
    SELECT doc_id, place, word, seen IS NOT NULL AND row_number() OVER (PARTITION BY seen ORDER BY doc_id, place) > 1 AS again FROM windows),
covered AS (
    SELECT doc_id, place, word, max(again::INTEGER) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone
    FROM repeated),
kept AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY place) FILTER (NOT gone), '') AS text
    FROM covered GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""

VECTOR_LINKS = f"""
WITH RECURSIVE sound AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT p.vec_id AS a, q.vec_id AS b FROM sound p JOIN sound q ON p.vec_id <> q.vec_id
    WHERE list_inner_product(p.v, q.v) >= 0.95 * sqrt(list_inner_product(p.v, p.v)) * sqrt(list_inner_product(q.v, q.v))),
nodes AS (SELECT vec_id AS node FROM embeddings),
{_components("nodes", "links")}
SELECT node AS vec_id, count(links.b) AS n_links, component AS component_id, node = component AS kept
FROM named LEFT JOIN links ON links.a = node GROUP BY node, component
"""

ORACLES = {
    "op6_minhash": NEAR_COPIES,
    "op7_passages": PASSAGES,
    "op8_embedding_links": VECTOR_LINKS,
    "op11_spelling": SPELLING,
    "op12_merkle": _merkle(5),
    "op13_bitsliced": SEARCH,
}
