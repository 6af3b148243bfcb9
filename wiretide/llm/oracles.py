"""DuckDB SQL of the queries that SQL can express.

Left out: language ID and quality rules (learned), packing and substring dedup (their cuts and bins
follow partitions or places in a text), byte-level BPE. Those are tested against brute force.
"""

from __future__ import annotations

from wiretide.llm import license_scan
from wiretide.llm.common import UPPER, alnum_words
from wiretide.llm.license_scan import BLOCK, PHRASES, TEMPLATES, needed

ORACLES: dict[str, str] = {}


def _lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{UPPER.lower()}')"


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"


def _words(text: str, pattern: str = _ALNUM) -> str:
    whole = f"coalesce({text}, '')"
    return f"regexp_extract_all({_lower(whole)}, '{pattern}')"


# -- url filters -------------------------------------------------------------------------------
_FITS = "(host = '{0}' OR ends_with(host, '.{0}'))".format
ORACLES["op1_url_filters"] = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
h AS (SELECT page_id, {_lower("regexp_extract(rest, '^[^/?#]*')")} AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE WHEN {_FITS("www.example.com")} AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN {_FITS("example.com")} AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN {_FITS("com")} AND starts_with(path, '/') THEN 'com/'
  WHEN {_FITS("net")} AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN {_FITS("net")} AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule FROM h)
SELECT page_id, host, path, rule,
 CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r"""


# -- secret scan -------------------------------------------------------------------------------
def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(
    [*map(_any_case, ("password", "passwd", "secret", "token")), f"{_any_case('api')}_?{_any_case('key')}"]
)
_KINDS = (
    ("assign", rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, "length(value) >= 8"),
    ("access", "(A)(KIA[A-Z0-9]+)", 0, "length(value) >= 16"),
    ("hex", "[0-9a-f]{32,}", 0, "true"),
    (
        "mixed", "[A-Za-z0-9+/_-]{24,}", 0,
        "regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')",
    ),
)
# starts: the lengths of all pieces between matches and of all matches before
_FOUND = " UNION ALL ".join(
    f"""SELECT doc_id, source, '{name}' AS kind, {k} AS place, start, start + length(m) AS past, value FROM (
  SELECT doc_id, source, m, regexp_extract(m, '{pattern}', {group}) AS value,
   CAST(sum(length(piece) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS BIGINT) AS start FROM (
   SELECT doc_id, source, unnest(found) AS m, unnest(pieces[1:len(found)]) AS piece, generate_subscripts(found, 1) AS i
   FROM (SELECT doc_id, source, regexp_extract_all(text, '{pattern}') AS found,
     regexp_split_to_array(text, '{pattern}') AS pieces FROM d) WHERE len(found) > 0)) WHERE {kept}"""
    for k, (name, pattern, group, kept) in enumerate(_KINDS)
)
_SPAN = "kind || ':' || start || ':' || past"
ORACLES["op3_secret_scan"] = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
c AS ({_FOUND}),
o AS (SELECT value, count(DISTINCT coalesce(source, chr(1))) AS owners FROM c GROUP BY 1),
s AS (SELECT * FROM c JOIN o USING (value) WHERE place < 3 OR owners <= 2),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, string_agg({_SPAN}, ',' ORDER BY start, place) FILTER (place < 3) AS base,
  string_agg({_SPAN}, ',' ORDER BY start, place) AS spans, count(*) FILTER (owners <= 2) AS n_live FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
 sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN g USING (doc_id)"""

# -- decontamination ---------------------------------------------------------------------------
ORACLES["op7_decontamination"] = f"""
WITH i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_words("text")} AS words FROM benchmark
  WHERE item_id IS NOT NULL),
w AS (SELECT DISTINCT item, k, words[p:p + k - 1] AS w FROM (SELECT item, words, least(len(words), 10) AS k,
  unnest(range(1, CAST(len(words) - least(len(words), 10) + 2 AS BIGINT))) AS p FROM i WHERE len(words) > 0)),
d AS (SELECT doc_id, {_words("text")} AS words FROM documents),
n AS (SELECT DISTINCT k FROM w),
p AS (SELECT doc_id, k, p, words[p:p + k - 1] AS w FROM (SELECT doc_id, words, k,
  unnest(range(1, CAST(len(words) - k + 2 AS BIGINT))) AS p FROM d, n WHERE len(words) >= k)),
h AS (SELECT doc_id, p, p.k, item FROM p JOIN w ON p.k = w.k AND p.w = w.w),
c AS (SELECT doc_id, count(DISTINCT hit) AS n_hit FROM (SELECT doc_id, p + unnest(range(k)) AS hit FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

# -- license scan ------------------------------------------------------------------------------
_TEMPLATE_WORDS = ", ".join(
    f"({k}, '{label}', {len(words)}, {needed(len(words), license_scan.THRESHOLD)}, '{word.decode()}')"
    for k, (label, text) in enumerate(TEMPLATES)
    for words in [sorted(set(alnum_words(text)))]
    for word in words
)
_PHRASE_ROWS = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())
ORACLES["op9_license_scan"] = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS words FROM documents),
f AS (SELECT * FROM (VALUES {_PHRASE_ROWS}) v(phrase, label)),
a AS (SELECT doc_id, p, label FROM (SELECT doc_id, words, unnest(range(CAST(len(words) AS BIGINT))) AS p FROM d), f
  WHERE words[p + 1:p + len(phrase)] = phrase),
b AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word,
  list_sort(list(DISTINCT label)) AS base FROM a GROUP BY 1),
t AS (SELECT * FROM (VALUES {_TEMPLATE_WORDS}) v(template, label, size, need, word)),
k AS (SELECT doc_id, block, unnest(list_distinct(words[block * {BLOCK // 2} + 1:block * {BLOCK // 2} + {BLOCK}])) AS word
  FROM (SELECT doc_id, words, unnest(range(greatest(CAST(ceil((len(words) - {BLOCK // 2}) / {BLOCK // 2}.0) AS BIGINT), 1)))
    AS block FROM d)),
m AS (SELECT doc_id, block, template, label, count(*) / CAST(any_value(size) AS DOUBLE) AS share FROM k JOIN t USING (word)
  GROUP BY doc_id, block, template, label HAVING count(*) >= any_value(need)),
x AS (SELECT doc_id, list(DISTINCT label) AS more, max(share) AS share, count(DISTINCT block) AS n_blocks FROM m GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
 coalesce(array_to_string(base, ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
 CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score, coalesce(n_blocks, 0) AS n_blocks
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN x USING (doc_id)"""

# -- near-dedup --------------------------------------------------------------------------------
ORACLES["op10_near_dedup"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text", _SPACED)} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) > 1
   THEN [words[i] || ' ' || words[i + 1] for i in range(1, CAST(len(words) AS BIGINT))] ELSE words END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b
  ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 80 * (x.n + y.n - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
c AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id,
 least(doc_id, coalesce(least, doc_id)) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


# -- CRC-32 ------------------------------------------------------------------------------------
# bitwise, by a table of 256 remainders of the reversed polynomial
_CRC_TABLE = """crc_bits(i, k, x) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL
  SELECT i, k + 1, xor(x >> 1, 3988292384 * (x & 1)) FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(x ORDER BY i) AS crc FROM crc_bits WHERE k = 8)"""


def _crc32(text: str) -> str:
    """Of ASCII text, where ``crc`` is the table."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda p: CAST(ord({text}[p]) AS BIGINT))"
    step = "xor(crc[xor(c, b) % 256 + 1], c >> 8)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {step}), 4294967295)"


# -- Merkle manifest ---------------------------------------------------------------------------
def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


def _tree(name: str, leaves: str) -> str:
    """Nodes of the trees over ``leaves`` (g, place, digest, n): g, level, place, digest, n (nodes of the level)."""
    return f"""{name}(g, level, place, digest, n) AS (SELECT g, 0, place, digest, n FROM {leaves} UNION ALL
  SELECT g, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2 FROM {name} WHERE n > 1
  GROUP BY g, level, place // 2, n)"""


def _steps(tree: str, leaves: str, key: str) -> str:
    """Per leaf its siblings up the tree: L before, R after, - none."""
    return f"""SELECT l.{key}, list(CASE WHEN s.digest IS NULL THEN '-' WHEN s.place % 2 = 0 THEN 'L' || s.digest
   ELSE 'R' || s.digest END ORDER BY t.level) FILTER (t.level IS NOT NULL) AS steps
  FROM {leaves} l LEFT JOIN (SELECT DISTINCT g, level, n FROM {tree} WHERE n > 1) t ON t.g = l.g
  LEFT JOIN {tree} s ON s.g = l.g AND s.level = t.level AND s.place = xor(l.place // (1 << t.level), 1)
  GROUP BY l.{key}"""


_FOLD = """list_reduce(list_prepend(start, steps), lambda a, x: CASE left(x, 1) WHEN 'L' THEN sha256(substr(x, 2) || a)
   WHEN 'R' THEN sha256(a || substr(x, 2)) ELSE sha256(a) END)"""
ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS number, doc_id, coalesce('=' || lang, '-') AS g, {_leaf("n_chars")} AS digest,
  CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("(CAST(n_chars AS HUGEINT) + 1)")} END AS changed
  FROM documents, crc_table),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS place,
  count(*) OVER (PARTITION BY g) AS n FROM d),
{_tree("t", "l")},
s AS (SELECT g AS lang_key, '' AS g, digest, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n
  FROM t WHERE n = 1),
{_tree("u", "s")},
a AS ({_steps("t", "l", "number")}),
b AS ({_steps("u", "s", "lang_key")}),
p AS (SELECT doc_id, l.digest AS leaf, s.digest AS subroot, (SELECT digest FROM u WHERE n = 1) AS root,
  coalesce(changed, l.digest) AS start, list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps
  FROM l JOIN s ON s.lang_key = l.g JOIN a USING (number) JOIN b USING (lang_key)),
f AS (SELECT *, {_FOLD} AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root,
 sha256(array_to_string(list_transform(steps, lambda x: substr(x, 2)), '')) AS proof_sha256, folded_root,
 folded_root = root AS verified FROM f"""

# -- prefix trie -------------------------------------------------------------------------------
ORACLES["op13_prefix_trie"] = f"""
WITH RECURSIVE {_CRC_TABLE},
o AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL),
r AS (SELECT conv_id, {{'role': role, 'text': text}} AS said, row_number() OVER (PARTITION BY conv_id
  ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) - 1 AS rank FROM o),
w AS (SELECT conv_id, list(said ORDER BY rank) AS said FROM r GROUP BY 1),
h AS (SELECT conv_id, said, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM w, crc_table),
c AS (SELECT x.conv_id, list_concat(coalesce(b.said[:x.h], []), x.said[x.h + 1:]) AS said
  FROM h x LEFT JOIN w b ON b.conv_id = x.conv_id - x.conv_id % 5),
p AS (SELECT conv_id, d, said[:d] AS path, len(said) = d AS last FROM (SELECT *, unnest(range(len(said) + 1)) AS d FROM c)),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
  (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(path[-1].text) END AS own,
  sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
k AS (SELECT path[:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
t AS (SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.own) AS saved
  FROM (SELECT path, path[:a.d] AS up, own, n_children FROM m, (SELECT DISTINCT d FROM m) a WHERE a.d <= m.d) b
  JOIN m a ON a.path = b.up GROUP BY 1)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves,
 CAST(saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN t USING (path) LEFT JOIN n u ON m.d > 0 AND u.d = m.d - 1 AND u.path = m.path[:m.d - 1]"""
