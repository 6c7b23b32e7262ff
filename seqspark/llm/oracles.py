"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

#: The table of CRC-32 by its rule, as a list, and the checksum of a list of bytes.
CRC = """
crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i)))"""


def _crc(codes: str) -> str:
    """The checksum of a list of bytes; ``t`` is the table."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes of every level of the trees of a table (grp, place, total, node)."""
    return f"""
{name} AS (
  SELECT grp, 0 AS lvl, place, total, node FROM {leaves}
  UNION ALL
  SELECT grp, lvl + 1, place // 3, (any_value(total) + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM {name} WHERE total > 1 GROUP BY grp, lvl, place // 3)"""


def _proof_sql(name: str, tree: str, items: str) -> str:
    """Siblings of each item (item, grp, place), from its own level up."""
    return f"""
{name} AS (
  SELECT i.item, string_agg(n.node, '' ORDER BY n.lvl, n.place) AS proof
  FROM {items} i JOIN {tree} n ON n.grp = i.grp AND n.place // 3 = i.place // (3 ** (n.lvl + 1))::BIGINT AND n.place <> i.place // (3 ** n.lvl)::BIGINT
  GROUP BY i.item)"""


def _fold_sql(name: str, tree: str, items: str) -> str:
    """The node of each item (item, grp, place, node) level by level, with the siblings of the tree."""
    return f"""
{name} AS (
  SELECT item, grp, 0 AS lvl, place, node FROM {items}
  UNION ALL
  SELECT f.item, f.grp, f.lvl + 1, f.place // 3, sha256(string_agg(CASE WHEN n.place = f.place THEN f.node ELSE n.node END, '' ORDER BY n.place))
  FROM {name} f JOIN {tree} n ON n.grp = f.grp AND n.lvl = f.lvl AND n.place // 3 = f.place // 3 WHERE n.total > 1
  GROUP BY f.item, f.grp, f.lvl, f.place)"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))

MERKLE = f"""
WITH RECURSIVE {CRC},
leaves AS (
  SELECT doc_id, coalesce('s' || source, '') AS grp, sha256({_HEAD} || {_field("text")}) AS leaf,
    CASE WHEN {_crc("list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii((doc_id::VARCHAR)[k])::BIGINT)")} % 2 = 0
      THEN sha256({_HEAD} || {_field("replace(text, chr(10), '')")}) END AS tampered
  FROM documents, crc_table),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY grp, doc_id NULLS FIRST, leaf) AS item, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY grp) AS total, leaf AS node FROM leaves),
{_tree_sql("lower_tree", "ordered").strip()},
tops AS (SELECT grp AS name, node AS subroot FROM lower_tree WHERE total = 1),
subroots AS (SELECT name, '' AS grp, row_number() OVER (ORDER BY name) - 1 AS place, count(*) OVER () AS total, subroot AS node FROM tops),
{_tree_sql("upper_tree", "subroots").strip()},
root_of AS (SELECT node AS root FROM upper_tree WHERE total = 1),
{_proof_sql("lower_proof", "lower_tree", "ordered").strip()},
named AS (SELECT name AS item, grp, place FROM subroots),
{_proof_sql("upper_proof", "upper_tree", "named").strip()},
first_fold AS (SELECT item, grp, place, coalesce(tampered, leaf) AS node FROM ordered),
{_fold_sql("lower_fold", "lower_tree", "first_fold").strip()},
second_fold AS (
  SELECT f.item, '' AS grp, s.place, f.node FROM (SELECT item, grp, arg_max(node, lvl) AS node FROM lower_fold GROUP BY item, grp) f JOIN subroots s ON s.name = f.grp),
{_fold_sql("upper_fold", "upper_tree", "second_fold").strip()},
folded AS (SELECT item, arg_max(node, lvl) AS folded_root FROM upper_fold GROUP BY item)
SELECT o.doc_id, o.leaf, t.subroot, r.root, sha256(coalesce(p.proof, '') || coalesce(u.proof, '')) AS proof_sha256, f.folded_root, f.folded_root = r.root AS verified
FROM ordered o JOIN tops t ON t.name = o.grp JOIN folded f USING (item) LEFT JOIN lower_proof p USING (item) LEFT JOIN upper_proof u ON u.item = o.grp, root_of r
"""

_BYTES = "flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END))"

SPELLING = f"""
WITH RECURSIVE {CRC},
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
sums AS (SELECT run, n, {_crc(_BYTES)} AS h FROM own, crc_table),
typed AS (SELECT n, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM sums),
words AS (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, k, left(word, k) || substr(word, k + 2) AS rest FROM words, (SELECT unnest(range(200)) AS k) WHERE k < length(word)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, n, count(*) AS n_near, max(other_n) AS most, arg_min(other, (-other_n, other)) AS other FROM near GROUP BY word, n),
forms AS (SELECT word, other AS form, most AS form_n FROM best WHERE most >= 5 * n),
walk AS (SELECT word, form AS root, 1 AS step FROM forms UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN forms f ON f.word = w.root),
roots AS (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY word)
SELECT w.word, f.form, coalesce(r.root, w.word) AS root, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.form_n
FROM words w LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word) LEFT JOIN roots r USING (word)
"""
