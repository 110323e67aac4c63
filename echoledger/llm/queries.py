"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from echoledger.llm import archive, bpe, decontaminate, fingerprints, licenses, mixing, neardup, pagediff, phrases, quality, suffixes, tokenfiles, turns

#: Vocabulary file of the token queries; a parameter of the operators.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), VOCABULARY)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.round_trip(_table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scores(_table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op9_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(_table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.checksums(_table(spark, sf_dir, "documents"), VOCABULARY)


def op11_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.main_texts(_table(spark, sf_dir, "pages"))


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.damaged_reports(_table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_archive": op2_archive,
    "op3_decontaminate": op3_decontaminate,
    "op4_bpe": op4_bpe,
    "op5_context_mixing": op5_context_mixing,
    "op6_fingerprints": op6_fingerprints,
    "op7_quality": op7_quality,
    "op8_token_files": op8_token_files,
    "op9_repeated_spans": op9_repeated_spans,
    "op10_licenses": op10_licenses,
    "op11_page_text": op11_page_text,
    "op12_turns": op12_turns,
    "op13_collocations": op13_collocations,
}

ORACLE = {
    "op1_near_duplicates": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS i FROM w),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM p),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        e AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM e JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
        r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach),
        m AS (SELECT id, min(reach) AS root FROM r GROUP BY id)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
        FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op2_archive": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
             f AS (SELECT d, min(page_id) AS first FROM p GROUP BY d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
        FROM p JOIN f ON p.d = f.d""",
    # Every page of the tables has one article of headings and paragraphs, cut references included.
    "op11_page_text": r"""
        WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*)</article>', 1, 's') AS h FROM pages),
        b AS (SELECT page_id, url, string_split_regex(regexp_replace(regexp_replace(h, '<br>', ' ', 'g'), '</?b>', '', 'g'), '</?[a-z][^>]*>') AS bs FROM a),
        t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(bs, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(
                  x, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM b)
        SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t""",
    "op12_turns": r"""
        WITH RECURSIVE crc AS (
            SELECT list(v ORDER BY k) AS t FROM (
                SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
                FROM range(256) r(k))),
        c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
        h AS (SELECT c.*, xor(4294967295, list_reduce(
                     list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))),
                     lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 20 AS fate FROM c, crc),
        d AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
                     CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(CASE fate WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS x FROM h),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
        f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                             WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                             WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated'
                             ELSE '' END AS fault,
                     lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM o),
        g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
                     count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                     count(*) FILTER (fault = 'truncated') AS truncated,
                     count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
        ins(st, mid, cost, ed, made) AS (VALUES
            ('E', 'E', 0, '', []), ('E', 'U', 2, 'I', ['user:']), ('E', 'A', 4, 'II', ['user:', 'assistant:']),
            ('S', 'S', 0, '', []), ('S', 'U', 2, 'I', ['user:']), ('S', 'A', 4, 'II', ['user:', 'assistant:']),
            ('U', 'U', 0, '', []), ('U', 'A', 2, 'I', ['assistant:']), ('U', 'U', 4, 'II', ['assistant:', 'user:']),
            ('A', 'A', 0, '', []), ('A', 'U', 2, 'I', ['user:']), ('A', 'A', 4, 'II', ['user:', 'assistant:'])),
        own(mid, op, initial, nxt, cost, role) AS (VALUES
            ('E', 'D', '', 'E', 3, ''), ('S', 'D', '', 'S', 3, ''), ('U', 'D', '', 'U', 3, ''), ('A', 'D', '', 'A', 3, ''),
            ('E', 'K', 's', 'S', 0, ''), ('E', 'K', 'u', 'U', 0, ''), ('S', 'K', 'u', 'U', 0, ''), ('A', 'K', 'u', 'U', 0, ''), ('U', 'K', 'a', 'A', 0, ''),
            ('E', 'R', '', 'U', 2, 'user'), ('S', 'R', '', 'U', 2, 'user'), ('A', 'R', '', 'U', 2, 'user'), ('U', 'R', '', 'A', 2, 'assistant')),
        walk AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 'E' AS st, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS made FROM conversations
            UNION ALL
            SELECT w.conv_id, f.i, own.nxt,
                   w.cost + ins.cost + own.cost + CASE WHEN own.op <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END AS cost,
                   w.audit || ins.ed || own.op AS audit,
                   list_concat(w.made, ins.made, CASE own.op WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [own.role || ':' || f.text] END)
            FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
            JOIN ins ON ins.st = w.st
            JOIN own ON own.mid = ins.mid AND (own.op <> 'K' OR own.initial = f.role[1]) AND (own.op = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
            QUALIFY row_number() OVER (PARTITION BY w.conv_id, own.nxt ORDER BY w.cost + ins.cost + own.cost + CASE WHEN own.op <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END,
                                                                                w.audit || ins.ed || own.op) = 1),
        done AS (SELECT w.conv_id, w.cost + e.cost AS cost, w.audit || e.ed AS audit, list_concat(w.made, e.made) AS made
                 FROM walk w LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id
                 JOIN (VALUES ('E', 0, '', []), ('A', 0, '', []), ('U', 2, 'I', ['assistant:']), ('S', 4, 'II', ['user:', 'assistant:'])) e(st, cost, ed, made)
                   ON e.st = w.st
                 WHERE w.i = coalesce(g.n, 0)
                 QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + e.cost, w.audit || e.ed) = 1)
        SELECT done.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
               sha256(array_to_string(made, chr(10))) AS repaired_sha256
        FROM done LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM done.conv_id""",
    "op13_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
        g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
              FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) t(k))
              GROUP BY lang, k, phrase HAVING count(*) >= 30),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1),
        cuts AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j + 1:k], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
        scored AS (SELECT cuts.lang, cuts.phrase, a, j, x.f AS l, y.f AS r, CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS score
                   FROM cuts JOIN g x ON x.lang = cuts.lang AND x.phrase = lp JOIN g y ON y.lang = cuts.lang AND y.phrase = rp
                   QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, j) = 1),
        inside AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longest
                   FROM (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3)) t(m) WHERE m < k) GROUP BY 1, 2),
        kept AS (SELECT s.* FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
                 WHERE i.longest IS NULL OR 100 * CAST(i.longest AS HUGEINT) < 80 * CAST(s.a AS HUGEINT)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT r.lang, rank, phrase, a, l, r.r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM ranked r JOIN n ON n.lang = r.lang WHERE rank <= 2000""",
}
