"""SQL twins of the registered queries, for DuckDB on the same tables. Built from a few shared parts."""

from __future__ import annotations

from ..functions import mail
from ..functions import text as T

DAY0 = "epoch_us(TIMESTAMP '2024-01-01 00:00:00')"
CONV = f"""SELECT conv_id*1000+turn AS seq, role||'_'||(conv_id%10) AS sender, text,
  {DAY0} + ((conv_id//5)*60 + turn*3 + CASE WHEN turn>=4 THEN 11 ELSE 0 END)*60000000 AS us, 'ch_'||(conv_id%5) AS channel,
  CASE WHEN conv_id%3=0 THEN CAST(conv_id AS VARCHAR) END AS thread_id FROM conversations"""
EVENTS = """SELECT event_id AS seq, 'user_'||user_id AS sender, props AS text, epoch_us(ts) AS us, event_type AS channel,
  CAST(NULL AS VARCHAR) AS thread_id FROM events"""
DOCS = f"""SELECT doc_id AS seq, source AS sender, text, {DAY0} + doc_id*240000000 AS us, lang AS channel,
  CAST(NULL AS VARCHAR) AS thread_id FROM documents"""


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clusters(messages: str, gap_us: int = 600_000_000) -> str:
    """CTEs ``m`` (messages with cluster keys), ``c`` (clusters), ``mc`` (messages with cluster ids)."""
    return f"""WITH m0 AS ({messages}),
m1 AS (SELECT *, CASE WHEN thread_id IS NULL THEN 0 ELSE 1 END AS kind,
  us - lag(us) OVER (PARTITION BY channel, thread_id IS NULL ORDER BY us, seq) AS pause FROM m0),
m AS (SELECT *, CASE WHEN kind=0 THEN sum(CASE WHEN pause > {gap_us} THEN 1 ELSE 0 END)
  OVER (PARTITION BY channel, kind ORDER BY us, seq ROWS UNBOUNDED PRECEDING) END AS gap_no FROM m1),
c0 AS (SELECT channel, kind, gap_no, thread_id, min(us) AS start_us, max(us) AS end_us, count(DISTINCT sender) AS participant_count,
  count(*) AS message_count, min(seq) AS first_seq FROM m GROUP BY channel, kind, gap_no, thread_id),
c1 AS (SELECT *, min(first_seq) OVER (PARTITION BY channel) AS ch_first FROM c0),
c AS (SELECT *, row_number() OVER (ORDER BY ch_first, kind, gap_no, first_seq) - 1 AS cluster_no FROM c1),
mc AS (SELECT m.*, 'cluster_'||c.cluster_no AS cluster_id, c.cluster_no, c.start_us FROM m JOIN c ON m.channel=c.channel AND m.kind=c.kind
  AND m.gap_no IS NOT DISTINCT FROM c.gap_no AND m.thread_id IS NOT DISTINCT FROM c.thread_id)"""


CLUSTER_ROWS = """,
p AS (SELECT cluster_id, string_agg(sender, '|' ORDER BY us, seq) AS participants FROM
  (SELECT cluster_id, sender, us, seq, row_number() OVER (PARTITION BY cluster_id, sender ORDER BY us, seq) AS r FROM mc) WHERE r=1 GROUP BY cluster_id)
SELECT 'cluster_'||cluster_no AS cluster_id, channel, thread_id, start_us, end_us, participants, participant_count, message_count
FROM c JOIN p ON p.cluster_id = 'cluster_'||cluster_no"""


def tokens(text: str) -> str:
    """A list of tokens."""
    stop = ", ".join(map(quoted, sorted(T.stopwords())))
    noise = "|".join(f"(?:{p})" for p in (T.NOISE, T.PHONE, T.PHONE_PART, T.HEX, T.DATE, T.HEX_START))
    plain = f"lower({text})"
    for pattern in (r"https?://\S+", r"[\w.-]+@[\w.-]+\.\w+", r"\[media\]|<media omitted>"):
        plain = f"regexp_replace({plain}, {quoted(pattern)}, '', 'g')"
    parts = f"string_split(regexp_replace({plain}, '[^a-z0-9''-]+', ' ', 'g'), ' ')"
    return f"list_filter({parts}, lambda w: length(w) > 2 AND length(w) < 40 AND w NOT IN ({stop}) AND NOT regexp_matches(w, {quoted(noise)}))"


def cluster_tokens(messages: str = CONV) -> str:
    """Adds ``t(cluster_id, token, n)``, ``tf``, ``bg`` (frequent bigrams) and ``terms`` (adjusted)."""
    return (
        clusters(messages)
        + f""",
t0 AS (SELECT cluster_id, us, seq, {tokens("text")} AS l FROM mc WHERE text IS NOT NULL),
t1 AS (SELECT cluster_id, us, seq, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM t0),
t AS (SELECT cluster_id, token, row_number() OVER (PARTITION BY cluster_id ORDER BY us, seq, i) AS n FROM t1),
tf AS (SELECT cluster_id, token, count(*) AS frequency, min(n) AS n FROM t GROUP BY cluster_id, token),
b0 AS (SELECT cluster_id, token AS a, lead(token) OVER (PARTITION BY cluster_id ORDER BY n) AS b, n FROM t),
bg AS (SELECT cluster_id, a, b, count(*) AS count, min(n) AS n FROM b0 WHERE b IS NOT NULL GROUP BY cluster_id, a, b HAVING count(*) >= 2),
taken AS (SELECT cluster_id, token, sum(count) AS taken FROM
  (SELECT cluster_id, a AS token, count FROM bg UNION ALL SELECT cluster_id, b, count FROM bg) GROUP BY cluster_id, token),
terms AS (SELECT tf.cluster_id, token AS name, CAST(greatest(0, frequency - coalesce(taken, 0)) AS BIGINT) AS frequency, 0 AS is_bigram, n
  FROM tf LEFT JOIN taken USING (cluster_id, token)
  UNION ALL SELECT cluster_id, a||' '||b, count, 1, n FROM bg)"""
    )


def entities(messages: str = CONV) -> str:
    """Adds ``top``: the top entities of each cluster, terms unfolded."""
    return (
        cluster_tokens(messages)
        + r""",
names AS (SELECT DISTINCT lower(sender) AS s, trim(regexp_replace(lower(sender), '[^a-z0-9\s''-]', '', 'g')) AS k FROM mc),
nt AS (SELECT s AS name FROM names UNION SELECT k FROM names UNION
  SELECT part FROM (SELECT unnest(string_split_regex(k, '\s+')) AS part FROM names) WHERE length(part) > 2),
e AS (SELECT cluster_id, name, frequency, row_number() OVER (PARTITION BY cluster_id ORDER BY is_bigram, n) AS place
  FROM terms WHERE frequency > 0 AND name NOT IN (SELECT name FROM nt)),
df AS (SELECT name, count(DISTINCT cluster_id) AS df FROM e GROUP BY name),
idf AS (SELECT name, df, ln((SELECT count(*) FROM c) / CAST(df AS DOUBLE)) AS idf FROM df),
sc AS (SELECT e.*, idf, frequency * CASE WHEN idf = 0 THEN 1.0 ELSE idf END AS tfidf FROM e JOIN idf USING (name)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY tfidf DESC, frequency DESC, place) AS rank
  FROM sc WHERE frequency >= 2) WHERE rank <= 15)"""
    )


def graph(messages: str = CONV) -> str:
    """Adds ``nodes`` and ``edges`` of the unfolded graph."""
    return (
        entities(messages)
        + """,
sent AS (SELECT cluster_id, channel, sender, count(*) AS weight FROM mc GROUP BY cluster_id, channel, sender),
raw AS (SELECT cluster_id, string_agg(sender||': '||coalesce(text, ''), chr(10) ORDER BY us, seq) AS raw_text FROM mc GROUP BY cluster_id),
topc AS (SELECT top.*, c.start_us, c.cluster_no FROM top JOIN c ON top.cluster_id = 'cluster_'||c.cluster_no),
n0 AS (
  SELECT 'person:'||sender AS id, 'person' AS type, sender AS name, NULL AS channel, CAST(NULL AS BIGINT) AS global_frequency, NULL AS raw_text,
    0 AS o1, CAST(NULL AS BIGINT) AS t, min(seq) AS s FROM m0 GROUP BY sender
  UNION ALL SELECT 'channel:'||channel, 'channel', channel, NULL, NULL, NULL, 1, NULL, min(seq) FROM m0 GROUP BY channel
  UNION ALL SELECT 'cluster_'||c.cluster_no, 'cluster', NULL, c.channel, NULL, raw_text, 2, start_us, cluster_no FROM c JOIN raw ON raw.cluster_id = 'cluster_'||c.cluster_no
  UNION ALL SELECT 'entity:'||name, 'entity', name, NULL, sum(frequency), NULL, 2, min(start_us), arg_min(cluster_no, CAST(start_us AS HUGEINT)*10000000+cluster_no) FROM topc GROUP BY name),
nodes AS (SELECT *, row_number() OVER (ORDER BY o1, t NULLS FIRST, s, type, id) - 1 AS node_seq FROM n0),
edges AS (
  SELECT 'channel:'||channel AS src, 'cluster_'||cluster_no AS dst, 'CONTAINS' AS type, 1.0::DOUBLE AS weight FROM c
  UNION ALL SELECT 'person:'||sender, cluster_id, 'SENT_IN', weight FROM sent
  UNION ALL SELECT cluster_id, 'entity:'||name, 'MENTIONS', tfidf FROM top
  UNION ALL SELECT 'entity:'||a.name, 'entity:'||b.name, 'CO_OCCURS', least(a.frequency, b.frequency) FROM top a JOIN top b
    ON a.cluster_id=b.cluster_id AND a.rank < b.rank AND b.rank <= 10
  UNION ALL SELECT 'person:'||sender, 'channel:'||channel, 'PARTICIPATES', sum(weight) FROM sent GROUP BY sender, channel
  UNION ALL SELECT 'person:'||a.sender, 'person:'||b.sender, 'INTERACTS', sum(least(a.weight, b.weight)) FROM sent a JOIN sent b
    ON a.cluster_id=b.cluster_id AND a.sender < b.sender GROUP BY a.sender, b.sender)"""
    )


def ranks(rounds: int) -> str:
    """Adds ``pr(id, pagerank)`` after so many rounds."""
    parts = [
        """,
w AS (SELECT src, dst, sum(weight) AS w FROM edges GROUP BY src, dst),
mv AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM w),
cnt AS (SELECT count(*)::DOUBLE AS n FROM nodes),
hangs AS (SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM w)),
r0 AS (SELECT id, 1.0 / n AS r FROM nodes, cnt)"""
    ]
    for i in range(1, rounds + 1):
        parts.append(f""",
r{i} AS MATERIALIZED (SELECT nodes.id, 0.15 / n + 0.85 * (coalesce(got, 0.0) + (SELECT coalesce(sum(r), 0.0) FROM r{i - 1} JOIN hangs USING (id)) / n) AS r
  FROM nodes CROSS JOIN cnt LEFT JOIN (SELECT dst AS id, sum(p * r) AS got FROM mv JOIN r{i - 1} ON mv.src = r{i - 1}.id GROUP BY dst) USING (id))""")
    return "".join(parts) + f",\npr AS (SELECT id, r AS pagerank FROM r{rounds})"


def converged(most: int = 60, tolerance: float = 1e-6) -> str:
    """Adds ``pr(id, pagerank)`` of the first round whose ranks differ from the last by less than ``tolerance`` a node."""
    rounds = ranks(most).rpartition(",\npr AS")[0]
    moved = " UNION ALL ".join(f"SELECT {i} AS i, sum(abs(a.r - b.r)) AS d FROM r{i} a JOIN r{i - 1} b USING (id)" for i in range(1, most + 1))
    picked = " UNION ALL ".join(f"SELECT r{i}.* FROM r{i} JOIN stop ON i = {i}" for i in range(1, most + 1))
    return rounds + f""",
stop AS (SELECT min(i) AS i FROM ({moved}), cnt WHERE d < {tolerance} * n),
pr AS (SELECT id, r AS pagerank FROM ({picked}))"""


def deduplicated(rounds: int = 8) -> str:
    """Adds ``fin(old, new)``: entities and the forms they fold into."""
    steps = "".join(
        f""",
f{i} AS (SELECT a.old, coalesce(b.new, a.new) AS new FROM f{i - 1} a LEFT JOIN f0 b ON b.old = a.new WHERE a.old <> coalesce(b.new, a.new))"""
        for i in range(1, rounds + 1)
    )
    return f""",
ent AS (SELECT id, name, global_frequency, node_seq FROM nodes WHERE type = 'entity'),
forms AS (SELECT id, node_seq, 1 AS k, CASE WHEN ends_with(name, 's') AND NOT ends_with(name, 'ss') AND length(name) > 3 THEN substr(name, 1, length(name) - 1) END AS base FROM ent
  UNION ALL SELECT id, node_seq, 2, CASE WHEN ends_with(name, 'es') AND length(name) > 4 THEN substr(name, 1, length(name) - 2) END FROM ent
  UNION ALL SELECT id, node_seq, 3, CASE WHEN len(string_split(name, ' ')) = 2 AND split_part(name, ' ', 1) <> split_part(name, ' ', 2)
    THEN split_part(name, ' ', 2)||' '||split_part(name, ' ', 1) END FROM ent),
f0 AS (SELECT forms.id AS old, 'entity:'||arg_max(base, k) AS new FROM forms JOIN ent ON ent.name = base WHERE k < 3 OR forms.node_seq < ent.node_seq GROUP BY forms.id){steps},
fin AS (SELECT * FROM f{rounds})"""


def merged(first: str = CONV, second: str = EVENTS) -> str:
    """CTEs of two graphs ``tn, te`` and ``sn, se``, and ``ids(id, type, new, merged)`` of the second's nodes."""
    clean = "trim(regexp_replace(lower(name), '[^a-z0-9\\s''-]', '', 'g'))"
    return f"""WITH tn AS ({graph(first)} SELECT * FROM nodes), te AS ({graph(first)} SELECT * FROM edges),
sn AS ({graph(second)} SELECT * FROM nodes), se AS ({graph(second)} SELECT * FROM edges),
tp AS (SELECT id, node_seq, lower(name) AS whole, {clean} AS clean FROM tn WHERE type = 'person'),
firm AS (SELECT whole AS key, node_seq * 9 AS o, id FROM tp UNION ALL SELECT clean, node_seq * 9 + 1, id FROM tp WHERE clean <> '' AND clean <> whole),
soft AS (SELECT string_split_regex(clean, '\\s+')[1] AS key, node_seq AS o, id FROM tp WHERE length(string_split_regex(clean, '\\s+')[1]) > 2),
keys AS (SELECT key, arg_max(id, o) AS hit FROM firm GROUP BY key
  UNION ALL SELECT key, arg_min(id, o) FROM soft WHERE key NOT IN (SELECT key FROM firm) GROUP BY key),
tried AS (SELECT id, 0 AS k, lower(name) AS key FROM sn WHERE type = 'person' UNION ALL SELECT id, 1, {clean} FROM sn WHERE type = 'person'
  UNION ALL SELECT id, 2, string_split_regex({clean}, '\\s+')[1] FROM sn WHERE type = 'person'),
found AS (SELECT id, arg_min(hit, k) AS hit FROM tried JOIN keys USING (key) GROUP BY id),
ids AS (SELECT sn.id, sn.type, coalesce(hit, tn.id, sn.id) AS new, coalesce(hit, tn.id) IS NOT NULL AS merged FROM sn LEFT JOIN found ON found.id = sn.id LEFT JOIN tn ON tn.id = sn.id WHERE sn.type = 'person'
  UNION ALL SELECT sn.id, sn.type, coalesce(tn.id, sn.id), tn.id IS NOT NULL FROM sn LEFT JOIN tn ON tn.id = 'entity:'||sn.name WHERE sn.type = 'entity'
  UNION ALL SELECT sn.id, sn.type, CASE WHEN tn.id IS NULL THEN sn.id ELSE sn.id||'_2' END, false FROM sn LEFT JOIN tn ON tn.id = sn.id WHERE sn.type NOT IN ('person', 'entity'))"""


MERGED_NODES = """,
more AS (SELECT new, sum(coalesce(global_frequency, 0)) AS more FROM sn JOIN ids USING (id) WHERE merged AND sn.type = 'entity' GROUP BY new)
SELECT id, type, name, CAST(coalesce(global_frequency, 0) + coalesce(more, 0) AS BIGINT) AS global_frequency FROM tn LEFT JOIN more ON new = id
UNION ALL SELECT new, sn.type, name, CAST(coalesce(global_frequency, 0) AS BIGINT) FROM sn JOIN ids USING (id) WHERE NOT merged"""
MERGED_EDGES = """,
moved AS (SELECT a.new AS src, b.new AS dst, se.type, weight FROM se JOIN ids a ON a.id = src JOIN ids b ON b.id = dst),
meets AS (SELECT least(src, dst) AS p, greatest(src, dst) AS q, sum(weight) AS more FROM moved WHERE type = 'INTERACTS' GROUP BY p, q),
old AS (SELECT te.*, least(src, dst) AS p, greatest(src, dst) AS q FROM te)
SELECT least(src, dst) AS a, greatest(src, dst) AS b, type, round(CAST(weight + CASE WHEN type = 'INTERACTS' THEN coalesce(more, 0) ELSE 0 END AS DOUBLE), 6) AS weight FROM old LEFT JOIN meets USING (p, q)
UNION ALL SELECT p, q, 'INTERACTS', round(CAST(more AS DOUBLE), 6) FROM meets WHERE (p, q) NOT IN (SELECT (p, q) FROM old WHERE type = 'INTERACTS')
UNION ALL SELECT least(src, dst), greatest(src, dst), type, round(CAST(weight AS DOUBLE), 6) FROM moved WHERE type <> 'INTERACTS'"""


def html_to_text(c: str) -> str:
    for pattern, by in T._HTML:
        c = f"regexp_replace({c}, {quoted(pattern)}, {quoted(by)}, 'g')"
    c = f"regexp_replace({c}, '<[^>]+>', '', 'g')"
    for name, by in T._REFERENCES:
        c = f"replace({c}, {quoted(name)}, {quoted(by)})"
    c = f"regexp_replace({c}, '\\n{{3,}}', chr(10)||chr(10), 'g')"
    ws = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
    return f"regexp_replace(regexp_replace({c}, '^{ws}+', ''), '{ws}+$', '')"


def is_bot(email: str, name: str) -> str:
    listed = lambda xs: "(" + ", ".join(map(quoted, xs)) + ")"
    pattern = quoted("|".join(f"(?:{p})" for p in mail.BOT_PATTERNS))
    inside = " OR ".join(f"contains({name}, {quoted(s)})" for s in mail.BOT_SENDERS)
    return (
        f"({name} IN {listed(mail.BOT_SENDERS)} OR split_part({email}, '@', 1) IN {listed(mail.BOT_SENDERS)} OR {inside}"
        f" OR split_part({email}, '@', 2) IN {listed(mail.BOT_DOMAINS)} OR regexp_matches({email}, {pattern}) OR regexp_matches({name}, {pattern}))"
    )
