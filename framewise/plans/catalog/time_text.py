"""Windows along time and over documents, and text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions import text as tx
from framewise.operators import evaluate as ev
from framewise.operators import filters as flt
from framewise.operators import textprep as tp
from framewise.operators import timeline as tl
from framewise.plans.registry import query, r, rs
from framewise.plans.views import Tables

# ------------------------------------------------------------------ along time
# gaps between events of a user are hours here, so the limits are scaled by 60,000:
# 0.3 s -> 5 h, 0.12 s -> 2 h, 10 steps a second -> one step per 100 minutes
_GAP, _SMALL, _RATE = 18000.0, 7200.0, 1.0 / 6000.0
_LAGGED = "g AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS d FROM v_events)"


@query(
    "w1_split_sequences",
    f"""WITH {_LAGGED}, n AS (SELECT *, d IS NULL OR d > 18000e6 AS fresh FROM g),
    s AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER w - 1 AS sequence, max(CASE WHEN fresh THEN us END) OVER w AS start,
      max(CASE WHEN fresh THEN us END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old
      FROM n WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, CAST(sequence AS BIGINT) AS sequence, CAST(round_even((us - start) / 1e6 * (1e0 / 6000e0), 0) AS BIGINT) AS step,
      CASE WHEN fresh AND old IS NOT NULL THEN CASE WHEN round_even((us - old) / 1e6 * (1e0 / 6000e0), 0) < 10 THEN 1e0 ELSE 0e0 END END AS ended_short FROM s""",
    ("v_events",),
)
def _(t: Tables) -> DataFrame:
    out = tl.split_sequences(t.v_events, "user_id", "ts", _GAP, _RATE, 10, tie="event_id")
    return out.select("event_id", "sequence", "step", F.col("ended_short").cast("double").alias("ended_short"))


@query(
    "w2_missed_frames",
    f"""WITH {_LAGGED} SELECT event_id, CASE WHEN d > 7200e6 AND d <= 18000e6 THEN CAST(round_even(d / 1e6 * (1e0 / 6000e0) - 1, 0) AS BIGINT)
    ELSE 0 END AS missed FROM g""",
    ("v_events",),
)
def _(t: Tables) -> DataFrame:
    out = tl.missed_frames(t.v_events, "user_id", "ts", _SMALL, _GAP, _RATE, tie="event_id")
    return out.select("event_id", "missed")


@query(
    "w3_moving_rate",
    f"""WITH {_LAGGED}, s AS (SELECT *, count(d) OVER w AS n, sum(d) OVER w AS total FROM g
      WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT event_id, {rs('CASE WHEN d IS NULL THEN 0e0 ELSE n / (total / 1e6) END', 9)} AS rate FROM s""",
    ("v_events",),
)
def _(t: Tables) -> DataFrame:
    out = tl.moving_rate(t.v_events, "user_id", "ts", 5, tie="event_id")
    return out.select("event_id", r(F.col("rate"), 9).alias("rate"))


_GREEDY = """WITH RECURSIVE o AS (SELECT event_id, user_id, us, value, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM v_events),
    s AS (SELECT user_id, k, event_id, us AS last, true AS keep FROM o WHERE k = 1
      UNION ALL SELECT o.user_id, o.k, o.event_id, CASE WHEN {t} THEN o.us ELSE s.last END, {t}
      FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1)
    SELECT event_id FROM s WHERE keep"""


@query("f8_throttle", _GREEDY.format(t="o.us - s.last > 14400000000"), ("v_events",))
def _(t: Tables) -> DataFrame:
    rows = t.v_events.select("event_id", "user_id", "ts")
    return flt.throttle(rows, "user_id", 14400.0, tie="event_id", chunk=86400.0).select("event_id")


@query(
    "w4_detector_schedule",
    _GREEDY.format(t="(o.us - s.last > 14400000000 OR floor(o.value) % 4 = 0)"), ("v_events",),
)
def _(t: Tables) -> DataFrame:
    rows = t.v_events.withColumn("active", F.floor("value") % 4)
    out = tl.schedule(rows, "user_id", "ts", 14400.0, active="active", tie="event_id")
    return out.select("event_id")


@query(
    "w4_every_nth",
    """SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS k FROM v_events)
    WHERE k % 4 = 0""",
    ("v_events",),
)
def _(t: Tables) -> DataFrame:
    return tl.every_nth(t.v_events, "user_id", "ts", 4, tie="event_id").select("event_id")


# ---------------------------------------------------------------------- tokens
_SPLIT = "[w for w in regexp_split_to_array(text, '[ \\t\\r\\n\\x{202F}]+') if w <> '']"
TOKENS_SQL = f"toks AS (SELECT doc_id, {_SPLIT} AS l FROM documents)"


def tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.doc_tokens(F.col("text")).alias("l"))


@query(
    "p47_doc_tokens",
    f"WITH {TOKENS_SQL} SELECT doc_id, len(l) AS n, md5(array_to_string(l, '|')) AS digest FROM toks",
)
def _(t: Tables) -> DataFrame:
    return tokens(t).select("doc_id", F.size("l").cast("long").alias("n"), F.md5(F.array_join("l", "|")).alias("digest"))


@query(
    "p48_basic_tokenize",
    r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[^\P{C}\t\n\r]|\x{FFFD}', '', 'g'), '[\t\n\r\p{Zs}]', ' ', 'g') AS t FROM documents),
    l AS (SELECT doc_id, regexp_extract_all(regexp_replace(strip_accents(lower(t)), '\p{Mn}', '', 'g'),
      '[!-/:-@\[-`{-~\p{P}]|[^!-/:-@\[-`{-~\p{P}\s\x{2028}\x{2029}]+') AS l FROM c)
    SELECT doc_id, len(l) AS n, md5(array_to_string(l, '|')) AS digest FROM l""",
)
def _(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", tx.basic_tokenize(F.col("text")).alias("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("n"), F.md5(F.array_join("l", "|")).alias("digest"))


_WORDS = "words AS (SELECT DISTINCT lower(unnest(l)) AS word FROM toks)"
# whole words seen often, and two- to three-letter pieces of words
_VOCAB = """vocab AS (SELECT lower(w) AS token FROM (SELECT unnest(l) AS w FROM toks) GROUP BY 1 HAVING count(*) >= 20
    UNION SELECT substr(word, 1, 2) FROM words WHERE len(word) >= 2
    UNION SELECT '##' || substr(word, 3, 3) FROM words WHERE len(word) >= 5
    UNION SELECT '##' || right(word, 1) FROM words)"""


def vocabulary(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Distinct lower-case words of the documents, and a vocabulary made of them."""
    from framewise.session import cut_lineage

    counted = (
        tokens(t).select(F.explode("l").alias("w")).select(F.lower("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )
    counted = cut_lineage(counted)
    words = counted.select("word")
    n = F.char_length("word")
    vocab = (
        counted.filter("n >= 20").select(F.col("word").alias("token"))
        .unionByName(words.filter(n >= 2).select(F.substring("word", 1, 2).alias("token")))
        .unionByName(words.filter(n >= 5).select(F.concat(F.lit("##"), F.substring("word", 3, 3)).alias("token")))
        .unionByName(words.select(F.concat(F.lit("##"), F.right("word", F.lit(1))).alias("token")))
        .distinct()
    )
    return words, vocab


@query(
    "p49_wordpiece",
    f"""WITH RECURSIVE {TOKENS_SQL}, {_WORDS}, {_VOCAB},
    subs AS (SELECT word, s, e FROM (SELECT word, s, unnest(range(s, len(word) + 1)) AS e FROM
        (SELECT word, unnest(range(1, len(word) + 1)) AS s FROM words WHERE len(word) <= 200))
      WHERE (CASE WHEN s > 1 THEN '##' ELSE '' END || substr(word, s, e - s + 1)) IN (SELECT token FROM vocab)),
    longest AS (SELECT word, s, max(e) AS e FROM subs GROUP BY 1, 2),
    walk AS (SELECT word, CAST(1 AS BIGINT) AS at_, '' AS out FROM words
      UNION ALL SELECT w.word, l.e + 1, w.out || ' ' || CASE WHEN l.s > 1 THEN '##' ELSE '' END || substr(w.word, l.s, l.e - l.s + 1)
      FROM walk w JOIN longest l ON l.word = w.word AND l.s = w.at_)
    SELECT w.word, coalesce(ltrim(max(k.out)), '[UNK]') AS pieces FROM words w LEFT JOIN walk k ON k.word = w.word AND k.at_ = len(w.word) + 1 GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    words, vocab = vocabulary(t)
    return tp.wordpiece(words, vocab).select("word", F.array_join("pieces", " ").alias("pieces"))


_VOCAB_IDS = """ids AS (SELECT w AS token, row_number() OVER (ORDER BY count(*) DESC, w) AS id FROM (SELECT unnest(l) AS w FROM toks)
    GROUP BY 1 HAVING count(*) >= 5)"""


def numbered(t: Tables) -> DataFrame:
    """Tokens seen at least five times, numbered from 1 by falling frequency."""
    from framewise.operators.scale import ranked
    from framewise.session import cut_lineage

    counted = tokens(t).select(F.explode("l").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    kept = cut_lineage(counted.filter("n >= 5"))
    # the word itself breaks ties between equal counts
    by_count = ranked(kept, [], ["-n", "token"], "id", bucket=None)
    return by_count.select("token", "id")


@query(
    "p54_encode_tokens",
    f"""WITH {TOKENS_SQL}, {_VOCAB_IDS}, e AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS token FROM toks)
    SELECT d.doc_id, count(e.pos) AS n, coalesce(md5(string_agg(CAST(coalesce(ids.id, 0) AS VARCHAR), ',' ORDER BY pos)
      FILTER (e.pos IS NOT NULL)), md5('')) AS digest
    FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id LEFT JOIN ids ON ids.token = e.token GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    out = tp.encode(tokens(t), "doc_id", "l", numbered(t), unk=0)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n"),
        F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("digest"),
    )


@query(
    "p54_decode_tokens",
    f"""WITH {TOKENS_SQL}, e AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS token FROM toks),
    m AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 2 THEN token || '@@' ELSE token END AS token FROM e WHERE pos % 11 <> 7)
    SELECT doc_id, md5(rtrim(regexp_replace(replace(string_agg(token, ' ' ORDER BY pos), '@@ ', ''), '[^ ]*@@$', ''))) AS digest
    FROM m GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    # every position marked 7 of 11 carries the end mark, every third of five is an open piece
    from framewise.session import cut_lineage

    def marked(w, pos):
        return F.when(pos % 11 == 7, F.lit("</s>")).otherwise(F.when(pos % 5 == 2, F.concat(w, F.lit("@@"))).otherwise(w))

    def code(token):
        # ids by hash of the token; the end mark is 0
        return F.when(token == "</s>", F.lit(0).cast("long")).otherwise(F.xxhash64(token))

    rows = tokens(t).select("doc_id", F.transform("l", marked).alias("m"))
    vocab = rows.select(F.explode("m").alias("token")).distinct()
    vocab = cut_lineage(vocab.select("token", code(F.col("token")).alias("id")))
    coded = rows.select("doc_id", F.transform("m", code).alias("ids"))
    return tp.decode(coded, "doc_id", "ids", vocab, end_id=0).select("doc_id", F.md5("text").alias("digest"))


_PUNCT = tx.PUNCTUATION.replace("'", "''")
def norm_sql(text: str) -> str:
    """Normalised answer; words are split first, as texts hold only letters and ASCII marks."""
    bare = f"translate(lower({text}), '{_PUNCT}', '')"
    kept = f"[w for w in regexp_split_to_array({bare}, '\\s+') if w <> '' AND w NOT IN ('a', 'an', 'the')]"
    return f"array_to_string({kept}, ' ')"


@query("p50_normalize_answer", f"SELECT conv_id, turn, {norm_sql('text')} AS norm FROM conversations")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", tx.normalize_answer(F.col("text")).alias("norm"))


@query(
    "p51_clean_subwords",
    """SELECT doc_id, md5(array_to_string([w for w in regexp_split_to_array(replace(replace(text, 'an ', 'an@@ '), '@@ ', ''), '\\s+') if w <> ''], '|')) AS digest
    FROM documents""",
)
def _(t: Tables) -> DataFrame:
    marked = F.replace("text", F.lit("an "), F.lit("an@@ "))
    return t.documents.select("doc_id", F.md5(F.array_join(tx.clean_subwords(marked), "|")).alias("digest"))


# --------------------------------------------------------------------- windows
_LEN, _STRIDE = 100, 40
_WIN = f"""win AS (SELECT doc_id, l, i AS win_no, i * {_STRIDE} AS start, least({_LEN}, len(l) - i * {_STRIDE}) AS length
    FROM (SELECT doc_id, l, unnest(range(1 + CAST(ceil(greatest(len(l) - {_LEN}, 0) / {_STRIDE}e0) AS BIGINT))) AS i FROM toks WHERE len(l) > 0))"""


@query(
    "w6_doc_windows",
    f"""WITH {TOKENS_SQL}, {_WIN} SELECT doc_id, win_no, start, length, md5(array_to_string(l[start + 1:start + length], '|')) AS digest FROM win""",
)
def _(t: Tables) -> DataFrame:
    out = tp.doc_windows(tokens(t), "l", _LEN, _STRIDE)
    return out.select(
        "doc_id", F.col("window").alias("win_no"), F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"),
        F.md5(F.array_join("piece", "|")).alias("digest"),
    )


@query(
    "w7_max_context",
    f"""WITH {TOKENS_SQL}, {_WIN}, c AS (SELECT doc_id, start + p AS pos, win_no,
        row_number() OVER (PARTITION BY doc_id, start + p ORDER BY least(p, length - 1 - p) + length * 0.01e0 DESC, win_no) AS k
      FROM (SELECT doc_id, win_no, start, length, unnest(range(length)) AS p FROM win))
    SELECT doc_id, win_no, count(*) AS n, CAST(sum(pos) AS BIGINT) AS positions FROM c WHERE k = 1 GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    rows = tokens(t).select("doc_id", F.posexplode(tp.max_context(F.size("l"), _LEN, _STRIDE)).alias("pos", "win_no"))
    return rows.groupBy("doc_id", F.col("win_no").cast("long").alias("win_no")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("positions")
    )


@query(
    "w8_build_features",
    f"""WITH {TOKENS_SQL}, {_VOCAB_IDS}, asked AS (SELECT doc_id, l, l[1:2 + doc_id % 9] AS q FROM toks WHERE len(l) > 0),
    win AS (SELECT doc_id, l, q, i AS win_no, i * {_STRIDE} AS start, least(61 - len(q), len(l) - i * {_STRIDE}) AS length FROM (
      SELECT *, unnest(range(1 + CAST(ceil(greatest(len(l) - (61 - len(q)), 0) / {_STRIDE}e0) AS BIGINT))) AS i FROM asked)),
    f AS (SELECT doc_id, win_no, ['[CLS]'] || q || ['[SEP]'] || l[start + 1:start + length] || ['[SEP]'] AS toks_, len(q) AS q FROM win),
    e AS (SELECT doc_id, win_no, q, len(toks_) AS n, unnest(range(len(toks_))) AS pos, unnest(toks_) AS token FROM f)
    SELECT doc_id, win_no, CAST(max(n) AS BIGINT) AS n_mask, CAST(max(n - q - 2) AS BIGINT) AS n_segment, CAST(sum(coalesce(id, 0) * (pos + 1)) AS BIGINT) AS checksum
    FROM e LEFT JOIN ids USING (token) GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    # questions of 2 to 10 tokens leave different room in 64
    asked = tokens(t).withColumn("q", F.slice("l", F.lit(1), (F.col("doc_id") % 9).cast("int") + 2))
    wins = tp.doc_windows(asked, "l", F.lit(61) - F.size("q"), _STRIDE)
    out = tp.build_features(wins, F.col("q"), F.col("piece"), numbered(t), 64, ["doc_id", "window"])
    weighted = F.transform("input_ids", lambda x, i: x * (i + 1))

    def total(c):
        return F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x)

    return out.select(
        "doc_id", F.col("window").alias("win_no"), total("input_mask").alias("n_mask"), total("segment_ids").alias("n_segment"),
        total(weighted).alias("checksum"),
    )


@query(
    "w9_pad_batches",
    f"""WITH {TOKENS_SQL}, o AS (SELECT doc_id, len(l) AS length, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM toks)
    SELECT doc_id, batch, row_number() OVER (PARTITION BY batch ORDER BY length DESC, doc_id) - 1 AS slot, length,
      max(length) OVER (PARTITION BY batch) AS padded_to, CAST(ceil(max(length) OVER (PARTITION BY batch) / 8e0) * 8 AS BIGINT) AS target_to FROM o""",
)
def _(t: Tables) -> DataFrame:
    ids = F.transform("l", lambda w: F.char_length(w).cast("long"))
    rows = tokens(t).select("doc_id", ids.alias("ids"), F.transform("l", lambda w: F.char_length(w) * 1.0).alias("mel"))
    out = tp.pad_batches(rows, ["doc_id"], "ids", 16, 8, target="mel")
    return out.select(
        "doc_id", "batch", F.col("slot").cast("long").alias("slot"), F.col("length").cast("long").alias("length"),
        F.size("padded").cast("long").alias("padded_to"), F.size("target_padded").cast("long").alias("target_to"),
    )


# ------------------------------------------------------------------- text metrics


def turn_pairs(t: Tables) -> DataFrame:
    """User turns with the assistant turn that follows; turns number from 0, so it is a key join."""
    c = t.conversations
    answers = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("ref")).join(answers, ["conv_id", "turn"])


_PAIR_SQL = """pairs AS (SELECT u.conv_id, u.turn, [w for w in regexp_split_to_array(replace(u.text, '@@ ', ''), '\\s+') if w <> ''] AS r,
    [w for w in regexp_split_to_array(replace(a.text, '@@ ', ''), '\\s+') if w <> ''] AS h
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')"""
_GRAM = """(SELECT conv_id, turn, n, array_to_string({l}[i:i + n - 1], ' ') AS g, count(*) AS c
    FROM (SELECT conv_id, turn, {l}, n, unnest(range(1, len({l}) - n + 2)) AS i FROM pairs, range(1, 5) x(n)) GROUP BY ALL)"""


@query(
    "a29_bleu",
    f"""WITH {_PAIR_SQL}, rg AS {_GRAM.format(l='r')}, hg AS {_GRAM.format(l='h')},
    m AS (SELECT n, sum(least(rg.c, hg.c)) AS hits FROM hg JOIN rg USING (conv_id, turn, n, g) GROUP BY 1),
    p AS (SELECT n, sum(greatest(len(h) - n + 1, 0)) AS total FROM pairs, range(1, 5) x(n) GROUP BY 1),
    q AS (SELECT CASE WHEN min(coalesce(hits, 0)) > 0 THEN exp(avg(ln(coalesce(hits, 0) * 1e0 / total))) ELSE 0e0 END AS geo FROM p LEFT JOIN m USING (n)),
    s AS (SELECT CAST(sum(len(r)) AS BIGINT) AS ref_len, CAST(sum(len(h)) AS BIGINT) AS hyp_len FROM pairs)
    SELECT {rs('geo * CASE WHEN hyp_len > ref_len THEN 1e0 ELSE exp(1 - ref_len * 1e0 / hyp_len) END * 100')} AS bleu, ref_len, hyp_len FROM q, s""",
)
def _(t: Tables) -> DataFrame:
    out = ev.bleu(turn_pairs(t), ["conv_id", "turn"], "ref", "hyp")
    return out.select(r(F.col("bleu")).alias("bleu"), "ref_len", "hyp_len")


@query(
    "a30_qa_scores",
    f"""WITH truth AS (SELECT conv_id, turn AS answer, {norm_sql('text')} AS t FROM conversations),
    pred AS (SELECT conv_id, {norm_sql('text')} AS p FROM conversations WHERE turn = 0 AND conv_id % 7 <> 3),
    pairs AS (SELECT truth.conv_id, answer, t, p FROM truth LEFT JOIN pred USING (conv_id)),
    tw AS (SELECT conv_id, answer, w, count(*) AS c FROM (SELECT conv_id, answer, unnest(string_split(t, ' ')) AS w FROM pairs) WHERE w <> '' GROUP BY ALL),
    pw AS (SELECT conv_id, answer, w, count(*) AS c FROM (SELECT conv_id, answer, unnest(string_split(p, ' ')) AS w FROM pairs) WHERE w <> '' GROUP BY ALL),
    same AS (SELECT conv_id, answer, sum(least(tw.c, pw.c)) * 1e0 AS s FROM tw JOIN pw USING (conv_id, answer, w) GROUP BY 1, 2),
    scored AS (SELECT conv_id, CASE WHEN p = t THEN 1e0 ELSE 0e0 END AS e,
      coalesce(2 * (s / len(string_split(p, ' '))) * (s / len(string_split(t, ' '))) / (s / len(string_split(p, ' ')) + s / len(string_split(t, ' '))), 0e0) AS f
      FROM pairs LEFT JOIN same USING (conv_id, answer)),
    best AS (SELECT conv_id, max(e) AS e, max(f) AS f FROM scored GROUP BY 1)
    SELECT {rs('avg(e) * 100')} AS exact_match, {rs('avg(f) * 100')} AS f1, count(*) AS n FROM best""",
)
def _(t: Tables) -> DataFrame:
    c = t.conversations
    truth = c.select("conv_id", F.col("turn").alias("answer"), "text")
    pred = c.filter("turn = 0 and conv_id % 7 <> 3").select("conv_id", "text")
    out = ev.qa_scores(pred, truth, "conv_id", "answer")
    return out.select(r(F.col("exact_match")).alias("exact_match"), r(F.col("f1")).alias("f1"), "n")


@query(
    "k6_n_best_spans",
    f"""WITH b AS (SELECT vec_id, logits, other, [CASE WHEN i % 5 = 3 THEN '##x' ELSE 't' || (i % 4) END for i in range(32)] AS tk FROM v_logits),
    s AS (SELECT vec_id, i, logits[i + 1] AS v, row_number() OVER (PARTITION BY vec_id ORDER BY logits[i + 1] DESC, i) AS k FROM b, range(32) x(i)),
    e AS (SELECT vec_id, i, other[i + 1] AS v, row_number() OVER (PARTITION BY vec_id ORDER BY other[i + 1] DESC, i) AS k FROM b, range(32) x(i)),
    p AS (SELECT b.vec_id, s.i AS start, e.i AS stop, s.v + e.v AS score,
        replace(replace(array_to_string(tk[s.i + 1:e.i + 1], ' '), ' ##', ''), '##', '') AS text
      FROM b JOIN s ON s.vec_id = b.vec_id AND s.k <= 10 JOIN e ON e.vec_id = b.vec_id AND e.k <= 10
      WHERE e.i >= s.i AND e.i - s.i + 1 <= 8 AND s.i % 3 <> 0),
    f AS (SELECT *, row_number() OVER (PARTITION BY vec_id, text ORDER BY score DESC, start, stop) AS d FROM p),
    o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, start, stop) AS rank FROM f WHERE d = 1)
    SELECT vec_id, CAST(rank AS BIGINT) AS rank, text, start, stop AS "end", {rs('score')} AS score,
      {rs('exp(score) / sum(exp(score)) OVER (PARTITION BY vec_id)')} AS prob FROM o WHERE rank <= 10""",
    ("v_logits",),
)
def _(t: Tables) -> DataFrame:
    at = F.sequence(F.lit(0), F.lit(31))
    toks = F.transform(
        at, lambda i: F.when(i % 5 == 3, F.lit("##x")).otherwise(F.concat(F.lit("t"), (i % 4).cast("string")))
    )
    rows = t.v_logits.select(
        "vec_id", F.col("logits").alias("start_logits"), F.col("other").alias("end_logits"), toks.alias("tokens"),
        F.transform(at, lambda i: i % 3 != 0).alias("usable"),
    )
    out = ev.n_best(rows, ["vec_id"], 10, 8)
    return out.select(
        "vec_id", F.col("rank").cast("long").alias("rank"), "text", "start", "end", r(F.col("score")).alias("score"),
        r(F.col("prob")).alias("prob"),
    )


