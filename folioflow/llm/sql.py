"""DuckDB SQL for the queries of this subpackage that SQL can express."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

EXACT_DEDUP = f"""
WITH hashed AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY text_sha256)
"""

MIXING = f"""
WITH sized AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
turns AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM totals),
weighed AS (SELECT *, CASE turn % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, source_size * 3.0::DOUBLE AS most FROM turns),
ordered AS (SELECT *, most / weight AS ratio FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE
             - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own
  FROM ordered),
level AS (SELECT arg_min(own, ratio) FILTER (ratio > own) AS level FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR ratio <= level THEN most ELSE weight * level END AS target,
         ('0x' || md5('mix-1:' || coalesce('s' || source, 'n'))[1:8])::BIGINT / 4294967296.0::DOUBLE AS u
  FROM levels, level),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size,
           ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT % floor(sqrt((SELECT count(*) FROM documents)))::BIGINT, doc_id) AS rank
  FROM sized),
stepped AS (
  SELECT doc_id, size, t.source_size, target,
         CASE WHEN t.source_size > 0 THEN target / t.source_size ELSE 0.0 END AS rate, u, rank
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, least(floor(rank * rate + u)::BIGINT - floor((rank - 1) * rate + u)::BIGINT, 3) AS copies FROM stepped)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM taken
"""

MINHASH = rf"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [hash(array_to_string(w, ' '))]
                      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: hash(array_to_string(w[i:i+3], ' ')))) END AS s
  FROM worded),
sized AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM sets),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM common JOIN sized x ON x.doc_id = u JOIN sized y ON y.doc_id = v
  WHERE 100 * n >= 80 * (x.n_shingles + y.n_shingles - n)),
pairs AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id, doc_id AS root FROM sized UNION SELECT b.v, r.root FROM reach r JOIN pairs b ON b.u = r.doc_id)
SELECT doc_id, n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM reach JOIN sized USING (doc_id) GROUP BY doc_id, n_shingles
"""

SUBSTRINGS = f"""
WITH worded AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, i, hash(array_to_string(w[i:i+12], ' ')) AS h, hash(reverse(array_to_string(w[i:i+12], ' '))) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM worded)),
late AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h, g) AS least FROM windows) WHERE least < doc_id),
covered AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS p FROM late),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM worded),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM placed ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM worded LEFT JOIN kept USING (doc_id)
"""

# what the generated pages hold besides their furniture: head, menu, advert, footer and comments
PAGES = r"""
WITH rest AS (
  SELECT page_id, url, regexp_replace(coalesce(html, ''), '(?s)<head>.*?</head>|<nav>.*?</nav>|<div class="ad">.*?</div>|<footer>.*?</footer>|<!.*?>', ' ', 'g') AS t FROM pages),
bare AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(html|body|article|p|h1|br|div|li|ul)[^>]*>', ' ', 'g'), '</?[a-zA-Z][^>]*>', '', 'g') AS t FROM rest),
decoded AS (
  SELECT page_id, url, regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;?', '&', 'g') AS t
  FROM bare),
tidy AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM decoded)
SELECT page_id, url, text, length(text) AS n_chars FROM tidy
"""


WARC = r"""
WITH sized AS (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
placed AS (SELECT *, row_number() OVER same AS n, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM sized WINDOW same AS (PARTITION BY payload_digest ORDER BY page_id, url))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND n > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND n > 1 THEN least END AS refers_to
FROM placed
"""


def _crc32(text: str) -> str:
    """The unsigned crc32 of an ASCII text, bit by bit."""
    byte = f"list_transform(range(1, len({text}) + 1), lambda i: ascii({text}[i])::BIGINT)"
    shifted = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce({byte}, lambda crc, b: list_reduce(range(8), lambda c, n: {shifted}, xor(crc, b)), 4294967295::BIGINT), 4294967295)"


PREFIX_TRIE = rf"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos, digest, words
  FROM (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, len({WORDS}) AS words
        FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32("(conv_id::VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT i.conv_id, 0 AS part, pos, digest, words FROM ids i JOIN turns t ON t.conv_id = base AND pos <= h
  UNION ALL SELECT i.conv_id, 1, pos, digest, words FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND pos > h),
placed AS (SELECT conv_id, row_number() OVER run AS d, string_agg(digest, '') OVER run AS path, words FROM rebuilt WINDOW run AS (PARTITION BY conv_id ORDER BY part, pos)),
members AS (
  SELECT conv_id, 0 AS d, '' AS node, NULL AS parent, 0 AS words FROM ids
  UNION ALL SELECT conv_id, d, md5(path), CASE WHEN d = 1 THEN '' ELSE md5(path[:-33]) END, words FROM placed),
ended AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS last FROM members),
nodes AS (
  SELECT d, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends FROM ended GROUP BY d, node),
family AS (SELECT v.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.parent = v.node AND c.d = v.d + 1) AS children FROM nodes v LEFT JOIN nodes u ON u.node = v.parent AND u.d = v.d - 1),
below AS (
  SELECT m.d, m.node, sum((v.n - 1) * v.words)::BIGINT AS saved, count(*) FILTER (v.children = 0) AS leaves
  FROM family v JOIN members m ON m.conv_id = v.conv_id AND m.d <= v.d GROUP BY m.d, m.node)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n AS n_convs, children AS n_children, leaves AS n_leaves, saved AS saved_tokens, ends AS ends_sha256
FROM family JOIN below USING (d, node)
"""


def _turn_repair() -> str:
    """The lattice row by row: for each state of the grammar the least of cost and audit, as a text of six digits and the audit."""

    def edit(key: str, price: str, letter: str) -> str:
        return f"(printf('%06d', {key}[1:6]::BIGINT + {price}) || {key}[7:] || '{letter}')"

    def inserted(us: str, ai: str, st: str, sy: str) -> tuple[str, str]:
        user = f"least({us}, {edit(st, '2', 'I')}, {edit(sy, '2', 'I')}, {edit(ai, '2', 'I')})"
        return user, f"least({ai}, {edit(user, '2', 'I')})"

    user, assistant = inserted("us", "ai", "st", "sy")

    def used(into: str, origins: list[str], initial: str | None) -> str:
        found = [f"CASE WHEN fault < 2 AND {key} IS NOT NULL THEN {edit(key, '2 + fault', 'R')} END" for key in origins if initial in ("u", "a")]
        found += [f"CASE WHEN fault < 2 AND initial = '{initial}' THEN {edit(key, 'fault', 'K')} END" for key in origins] if initial else []
        return f"least({', '.join([edit(into, '3', 'D'), *found])})"

    spaces = "||".join(f"chr({i})" for i in (32, 9, 10, 11, 12, 13))
    k = _crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")
    return rf"""
WITH RECURSIVE chosen AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {k} % 20 AS k FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM chosen),
placed AS (
  SELECT *, coalesce(conv_id::VARCHAR, '-') AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, rtrim(text, {spaces}) AS bare FROM damaged),
rows AS (
  SELECT *, role[1] AS initial, CASE WHEN bare = '' THEN 3 WHEN seen > 1 THEN 2 WHEN bare[-1] NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
         lag(role[1]) OVER (PARTITION BY c ORDER BY i) AS before FROM placed),
report AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY c),
lattice AS (
  SELECT DISTINCT c, 0::BIGINT AS i, '000000' AS st, NULL::VARCHAR AS sy, NULL::VARCHAR AS us, NULL::VARCHAR AS ai FROM rows
  UNION ALL
  SELECT f.c, r.i, {edit("st", "3", "D")}, {used("sy", ["st"], "s")}, {used("us", ["st", "sy", "ai"], "u")}, {used("ai", ["us"], "a")}
  FROM (SELECT c, i, st, sy, {user} AS us, {assistant} AS ai FROM lattice) f JOIN rows r ON r.c = f.c AND r.i = f.i + 1),
best AS (
  SELECT c, key[1:6]::BIGINT AS cost, key[7:] AS audit
  FROM (SELECT c, least(st, {assistant}) AS key, row_number() OVER (PARTITION BY c ORDER BY i DESC) AS n FROM lattice) WHERE n = 1),
letters AS (SELECT c, j, audit[j] AS letter FROM (SELECT c, audit, unnest(range(1, len(audit) + 1)) AS j FROM best)),
steps AS (SELECT *, count(*) FILTER (letter <> 'I') OVER run AS i, count(*) FILTER (letter <> 'D') OVER run AS p FROM letters WINDOW run AS (PARTITION BY c ORDER BY j)),
lines AS (SELECT s.c, s.j, s.letter, s.p, CASE s.letter WHEN 'I' THEN '' ELSE r.text END AS text, r.role FROM steps s LEFT JOIN rows r ON r.c = s.c AND r.i = s.i AND s.letter <> 'I' WHERE s.letter <> 'D'),
led AS (SELECT *, max(CASE WHEN p = 1 AND letter = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c) AS lead FROM lines),
written AS (
  SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN (p - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS repaired FROM led GROUP BY c)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '-') AS c FROM conversations) ids
LEFT JOIN report USING (c) LEFT JOIN best USING (c) LEFT JOIN written USING (c)
"""


TURN_REPAIR = _turn_repair()


def _spans(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    """The spans of one kind: lengths of matches and of the gaps between them give the places."""
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {order} AS kind_order, '{kind}' AS kind, s.span_start AS span_start, s.span_end AS span_end FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{
             'span_start': (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0))::BIGINT,
             'span_end': (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(hits[1:i], lambda h: length(h))))::BIGINT,
             'part': parts[i]}})) AS s
    FROM (SELECT doc_id, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS hits,
                 regexp_extract_all(text, '{p}', {group}) AS parts FROM documents WHERE regexp_matches(text, '{p}')))
  WHERE length(s.part) >= {least}"""


def _secrets() -> str:
    from folioflow.llm.secrets import BASE, RULES

    each = " UNION ALL ".join(_spans(r.kind, i, r.pattern, r.group, r.least) for i, r in enumerate(RULES))
    listed = "coalesce(string_agg(kind || ':' || span_start || ':' || span_end, ',' ORDER BY span_start, kind_order){}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH spans AS ({each})
SELECT d.doc_id, {counts}, sha256({listed.format(f" FILTER (kind_order < {len(BASE)})")}) AS base_sha256, {listed.format("")} AS spans
FROM documents d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""


SECRETS = _secrets()
