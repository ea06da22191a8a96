"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from checks.views import DIRT
from checks.queries import BPE_VOCAB, CHAR_VOCAB, FIRST_RUN, SECOND_RUN, TERMS, TURN_MAX_CHARS

# White space spelled out: RE2's \s is ASCII only.
SPACE = (
    r"[\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)

LINES = """
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
lines AS (SELECT a.doc_id * 4294967296 + a.i AS pair_id, a.line AS en, b.line AS vi
          FROM l a JOIN l b ON b.doc_id = a.doc_id + 1 AND a.doc_id // 2 = b.doc_id // 2 AND a.i = b.i)"""

ALL_LINES = """
all_lines AS (SELECT doc_id * 4294967296 + i AS line_id, text
              FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
                           generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""

TURNS = """
turns AS (SELECT u.conv_id * 4294967296 + u.turn AS pair_id, u.text AS en, a.text AS vi
          FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
          WHERE u.role = 'user' AND a.role = 'assistant')"""

METRICS = """
d AS (SELECT event_type AS run, CAST(ts AS DATE) AS day, round(avg(value), 6) AS val_loss FROM events GROUP BY 1, 2),
log AS (SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY day) AS INT) AS epoch, val_loss FROM d)"""

BEST = METRICS + """,
b AS (SELECT *, min(val_loss) OVER (PARTITION BY run ORDER BY epoch
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier_best FROM log),
best AS (SELECT *, val_loss < coalesce(earlier_best, 'infinity'::DOUBLE) AS improved FROM b)"""

WAITED = BEST + """,
waited AS (SELECT *, epoch - max(CASE WHEN improved THEN epoch END)
                       OVER (PARTITION BY run ORDER BY epoch) AS waited FROM best)"""


def scored(nth: int, name: str = "scored") -> str:
    return f"""
{name} AS (SELECT doc_id * 4294967296 + i AS sample_id, line AS source, line AS reference,
                  array_to_string(list_filter(string_split(line, ' '), lambda w, k: k % {nth} <> 0), ' ') AS translation
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                        generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
           WHERE line <> '')"""


def squeezed(column: str) -> str:
    return f"trim(regexp_replace({column}, '{SPACE}', ' ', 'g'), ' ')"


def cleaned(column: str) -> str:
    return squeezed(f"nfc_normalize({column})")


DEDUP = "(SELECT min(pair_id) AS pair_id, en, vi FROM {} GROUP BY en, vi)"


def dirtied(column: str) -> str:
    for plain, dirt in DIRT:
        column = f"replace({column}, '{plain}', '{dirt}')"
    return column


def measured(source: str) -> str:
    return f"""
c AS (SELECT pair_id, {cleaned("en")} AS en_normalized, {cleaned("vi")} AS vi_normalized FROM {source}),
measured AS (SELECT *, CAST(length(en_normalized) AS INT) AS en_length,
                    CAST(length(vi_normalized) AS INT) AS vi_length,
                    CASE WHEN length(en_normalized) > 0
                         THEN CAST(length(vi_normalized) AS DOUBLE) / length(en_normalized) END AS length_ratio FROM c)"""


def kept(max_len: int = 100) -> str:
    return f"""
kept AS (SELECT * FROM measured WHERE en_length BETWEEN 3 AND {max_len} AND vi_length BETWEEN 3 AND {max_len}
           AND length_ratio <= CAST(2.5 AS DOUBLE) AND length_ratio >= 1 / CAST(2.5 AS DOUBLE))"""


def reason(max_len: int = 100) -> str:
    return f"""CASE WHEN en_length IS NULL OR vi_length IS NULL THEN 'missing_text'
        WHEN en_length < 3 THEN 'en_short' WHEN en_length > {max_len} THEN 'en_long'
        WHEN vi_length < 3 THEN 'vi_short' WHEN vi_length > {max_len} THEN 'vi_long'
        WHEN length_ratio IS NULL THEN 'ratio_undefined'
        WHEN length_ratio > CAST(2.5 AS DOUBLE) THEN 'ratio_high'
        WHEN length_ratio < 1 / CAST(2.5 AS DOUBLE) THEN 'ratio_low' ELSE 'kept' END"""


HASH = "md5('42|' || CAST(pair_id AS VARCHAR))"
SPLIT = f"""CASE WHEN substr({HASH}, 1, 8) < 'cccccccc' THEN 'train'
        WHEN substr({HASH}, 1, 8) < 'e6666666' THEN 'val' ELSE 'test' END"""

KEPT = f"WITH {LINES}, {measured(DEDUP.format('lines'))}, {kept()}"
MEASURED = f"WITH {LINES}, {measured('lines')}"
MEASURED_TURNS = f"WITH {TURNS}, {measured('turns')}"

TEXT_HASH = "md5('42|' || en || '|' || vi)"
TEXT_SPLIT = SPLIT.replace(HASH, TEXT_HASH)
# Distinct pairs of both files, as reading gives them.
PREPARED = f"""{LINES}, {TURNS},
fields AS (SELECT string_split(regexp_replace(regexp_replace(en || chr(9) || vi, '^{SPACE}', ''), '{SPACE}$', ''), chr(9)) AS p
           FROM lines),
raw AS (SELECT row_number() OVER () AS pair_id, en, vi FROM (
          SELECT en, vi FROM turns UNION SELECT p[1], p[2] FROM fields WHERE len(p) >= 2)),
{measured("raw")}, {kept()}"""

# NaN as null: neither improves, nor counts as an earlier loss.
RAGGED = (
    METRICS.replace("log AS (", "full_log AS (")
    + f""",
log AS (SELECT run, epoch, val_loss / 2 AS train_loss, CASE WHEN epoch > 1 THEN val_loss END AS val_loss FROM full_log
        WHERE run <> '{SECOND_RUN}' OR epoch <= 20),
b AS (SELECT *, min(val_loss) OVER (PARTITION BY run ORDER BY epoch
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier_best FROM log),
best AS (SELECT *, coalesce(val_loss < coalesce(earlier_best, 'infinity'::DOUBLE), false) AS improved FROM b),
waited AS (SELECT *, epoch - coalesce(max(CASE WHEN improved THEN epoch END)
                       OVER (PARTITION BY run ORDER BY epoch), 0) AS waited FROM best)"""
)

# The data holds neither controls nor compatibility forms, so the rule for
# subwords only has to squeeze.
WORDS = f"""
{LINES}, {measured("lines")}, every AS (SELECT {cleaned("line")} AS text FROM l),
words AS (SELECT '▁' || w AS word, count(*) AS freq
          FROM (SELECT unnest(string_split(text, ' ')) AS w FROM every WHERE text <> '') GROUP BY 1),
chars AS (SELECT piece, CAST(sum(freq) AS BIGINT) AS freq
          FROM (SELECT unnest(string_split(word, '')) AS piece, freq FROM words) WHERE piece <> '' GROUP BY 1)"""

ENCODED = f"""{WORDS},
vocab AS (SELECT piece, 3 + row_number() OVER (ORDER BY freq DESC, piece) AS id FROM chars
          QUALIFY id < {CHAR_VOCAB}),
sides AS (SELECT pair_id, 's' AS side, en_normalized AS t FROM measured
          UNION ALL SELECT pair_id, 't', vi_normalized FROM measured),
symbols AS (SELECT pair_id, side, unnest(string_split('▁' || replace(t, ' ', '▁'), '')) AS piece,
                   generate_subscripts(string_split('▁' || replace(t, ' ', '▁'), ''), 1) AS k FROM sides WHERE t <> ''),
looked AS (SELECT pair_id, side, list(coalesce(id, 1) ORDER BY k) AS ids
           FROM symbols LEFT JOIN vocab USING (piece) GROUP BY ALL),
ids AS (SELECT pair_id, side, list_slice(list_concat(list_concat([2], coalesce(ids, [])), [3]), 1, 128) AS ids
        FROM sides LEFT JOIN looked USING (pair_id, side)),
encoded AS (SELECT s.pair_id, s.ids AS src_ids, t.ids AS tgt_ids
            FROM ids s JOIN ids t ON t.pair_id = s.pair_id AND s.side = 's' AND t.side = 't')"""


def batched(order: str) -> str:
    return f"""{ENCODED},
ranked AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS rn FROM encoded),
batched AS (SELECT *, rn // 32 AS batch_id, rn % 32 AS batch_pos,
                   max(len(src_ids)) OVER (PARTITION BY rn // 32) AS sw,
                   max(len(tgt_ids)) OVER (PARTITION BY rn // 32) AS tw FROM ranked),
padded AS (SELECT batch_id, batch_pos, len(src_ids) AS sl, len(tgt_ids) AS tl,
                  list_resize(src_ids, sw, 0) AS src, list_resize(tgt_ids, tw, 0) AS tgt FROM batched)"""


def by_batch(**columns: str) -> str:
    shown = ", ".join(
        f"string_agg({expression}, '{'|' if 'array_to_string' in expression else ' '}' ORDER BY batch_pos) AS {name}"
        for name, expression in columns.items()
    )
    return f"WITH {batched('pair_id')} SELECT batch_id, {shown} FROM padded GROUP BY batch_id"


def tokens(column: str) -> str:
    """The 13a rules, as one chain of replacements."""
    t = f"rtrim({column}, chr(9) || chr(10) || chr(13) || ' ')"
    t = f"replace(replace({t}, '<skipped>', ''), '-' || chr(10), '')"
    t = f"replace({t}, chr(10), ' ')"
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = f"replace({t}, '{entity}', '{char}')"
    t = f"' ' || {t} || ' '"
    for pattern, put in (
        (r"([\x7B-\x7E\x5B-\x60\x20-\x26\x28-\x2B\x3A-\x40\x2F])", r" \1 "),
        (r"([^0-9])([.,])", r"\1 \2 "),
        (r"([.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        t = f"regexp_replace({t}, '{pattern}', '{put}', 'g')"
    return f"list_filter(string_split({squeezed(t)}, ' '), lambda w: w <> '')"


def bleu(sample: str) -> str:
    return f"""
toks AS (SELECT sample_id, {tokens("translation")} AS hyp, {tokens("reference")} AS ref FROM {sample}),
orders AS (SELECT unnest([1, 2, 3, 4]) AS n),
hyp_grams AS (SELECT sample_id, n, list_slice(hyp, i, i + n - 1) AS gram, count(*) AS c
              FROM (SELECT sample_id, hyp, n, unnest(range(1, len(hyp) - n + 2)) AS i FROM toks, orders) GROUP BY ALL),
ref_grams AS (SELECT sample_id, n, list_slice(ref, i, i + n - 1) AS gram, count(*) AS c
              FROM (SELECT sample_id, ref, n, unnest(range(1, len(ref) - n + 2)) AS i FROM toks, orders) GROUP BY ALL),
hyp_side AS (SELECT n, CAST(sum(least(h.c, coalesce(r.c, 0))) AS BIGINT) AS matches, CAST(sum(h.c) AS BIGINT) AS hyp_total
             FROM hyp_grams h LEFT JOIN ref_grams r USING (sample_id, n, gram) GROUP BY n),
ref_side AS (SELECT n, CAST(sum(c) AS BIGINT) AS ref_total FROM ref_grams GROUP BY n),
totals AS (SELECT n, coalesce(matches, 0) AS matches, coalesce(hyp_total, 0) AS hyp_total,
                  coalesce(ref_total, 0) AS ref_total
           FROM orders LEFT JOIN hyp_side USING (n) LEFT JOIN ref_side USING (n)),
misses AS (SELECT *, sum(CASE WHEN matches = 0 AND hyp_total > 0 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS missed FROM totals),
precisions AS (SELECT n, CASE WHEN hyp_total = 0 THEN 0.0
                              WHEN matches > 0 THEN 100.0 * matches / hyp_total
                              ELSE 100.0 / (pow(2, missed) * hyp_total) END AS p FROM misses),
lengths AS (SELECT CAST(sum(len(hyp)) AS BIGINT) AS h, CAST(sum(len(ref)) AS BIGINT) AS r FROM toks),
penalty AS (SELECT h, r, CASE WHEN h = 0 THEN 0.0 ELSE exp(least(0.0, 1 - r / CAST(h AS DOUBLE))) END AS bp FROM lengths),
score AS (SELECT CASE WHEN (SELECT sum(matches) FROM totals) = 0 OR (SELECT min(p) FROM precisions) = 0 THEN 0.0
                      ELSE bp * (SELECT exp(avg(ln(p))) FROM precisions WHERE p > 0) END AS bleu,
                 bp AS brevity_penalty, h AS hyp_length, r AS ref_length FROM penalty)"""


ROUNDED = """SELECT round(bleu, 6) AS bleu, round(brevity_penalty, 6) AS brevity_penalty,
       hyp_length, ref_length FROM score"""


def protected(column: str) -> str:
    for term in TERMS:
        column = f"replace({column}, '{term}', '__{term.replace(' ', '_')}__')"
    return column


EVALUATED = f"""{LINES}, {measured("lines")},
sample AS (SELECT row_number() OVER (ORDER BY pair_id) - 1 AS sample_id, en_normalized AS source,
                  en_normalized AS reference,
                  array_to_string(list_reverse(string_split(en_normalized, ' ')), ' ') AS translation
           FROM measured WHERE {SPLIT} = 'test' QUALIFY sample_id < 128)"""

# One merge per step on words written as <a><b>, with marks for the brackets.
MERGES = f"""WITH RECURSIVE {WORDS},
wanted AS (SELECT {BPE_VOCAB} - 4 - count(*) AS n FROM chars),
steps AS (
  SELECT 0 AS step, regexp_replace(word, '(.)', chr(1) || '\\1' || chr(2), 'g') AS sym, freq,
         NULL::VARCHAR AS l, NULL::VARCHAR AS r, NULL::BIGINT AS cnt FROM words
  UNION ALL
  SELECT s.step + 1, replace(s.sym, chr(1) || b.l || chr(2) || chr(1) || b.r || chr(2), chr(1) || b.l || b.r || chr(2)),
         s.freq, b.l, b.r, b.cnt
  FROM steps s, (
    SELECT l, r, CAST(sum(freq) AS BIGINT) AS cnt FROM (
      SELECT unnest(p[1:-2]) AS l, unnest(p[2:-1]) AS r, freq
      FROM (SELECT string_split(sym[2:-2], chr(2) || chr(1)) AS p, freq FROM steps) WHERE len(p) > 1)
    GROUP BY 1, 2 ORDER BY cnt DESC, l, r LIMIT 1) b
  WHERE s.step < (SELECT n FROM wanted) AND b.cnt >= 1)
SELECT CAST(step - 1 AS INT) AS rank, any_value(l) AS l, any_value(r) AS r, any_value(cnt) AS freq
FROM steps WHERE step > 0 GROUP BY step"""

ORACLES: dict[str, str] = {
    "union_dedup_pairs": f"""WITH {LINES}, {TURNS}
        SELECT min(pair_id) AS pair_id, en, vi FROM (SELECT * FROM lines UNION ALL SELECT * FROM turns) GROUP BY en, vi""",
    "union_missing_columns": f"""WITH {LINES}, {TURNS}
        SELECT pair_id, en, vi, 'talk' AS topic FROM turns UNION ALL SELECT pair_id, en, vi, NULL FROM lines""",
    "nfc_text": f"WITH {ALL_LINES} SELECT line_id, nfc_normalize({dirtied('text')}) AS text FROM all_lines",
    "squeeze_text": f"WITH {TURNS} SELECT pair_id, {squeezed(dirtied('en'))} AS en, {squeezed(dirtied('vi'))} AS vi FROM turns",
    "clean_text_pairs": f"""WITH {LINES}, {TURNS}, both_views AS (SELECT * FROM lines UNION ALL SELECT * FROM turns)
        SELECT pair_id, {cleaned(dirtied("en"))} AS en_normalized, {cleaned(dirtied("vi"))} AS vi_normalized
        FROM {DEDUP.format("both_views")}""",
    "protect_terms_exact": f"""WITH {ALL_LINES},
        w AS (SELECT line_id, {protected(cleaned("text"))} AS t FROM all_lines),
        parts AS (SELECT line_id, string_split_regex(t, '__(.+?)__') AS outside,
                         regexp_extract_all(t, '__(.+?)__', 1) AS inside FROM w)
        SELECT line_id, array_to_string(list_transform(outside, lambda p, k:
                   p || coalesce(replace(inside[k], '_', ' '), '')), '') AS text FROM parts""",
    "protect_terms_safe": f"WITH {ALL_LINES} SELECT line_id, {cleaned(dirtied('text'))} AS text FROM all_lines",
    "measure_pairs": f"""{MEASURED}
        SELECT pair_id, en_length, vi_length, length_ratio FROM measured""",
    "filter_pairs": f"""{KEPT} SELECT pair_id, en_normalized, vi_normalized, en_length, vi_length,
        length_ratio FROM kept""",
    "filter_turns": f"""{MEASURED_TURNS}, {kept(TURN_MAX_CHARS)}
        SELECT pair_id, en_length, vi_length FROM kept""",
    "reject_reasons": f"{MEASURED} SELECT {reason()} AS stage, count(*) AS n_rows FROM measured GROUP BY 1",
    "reject_turns": f"{MEASURED_TURNS} SELECT pair_id, {reason(TURN_MAX_CHARS)} AS reason FROM measured",
    "split_by_hash": f"{KEPT} SELECT pair_id, {SPLIT} AS split FROM kept",
    "split_sizes": f"{KEPT} SELECT {SPLIT} AS stage, count(*) AS n_rows FROM kept GROUP BY 1",
    "split_exact": f"""WITH {LINES},
        r AS (SELECT pair_id, row_number() OVER (ORDER BY {HASH}, pair_id) - 1 AS rn, count(*) OVER () AS n FROM lines),
        s AS (SELECT *, ceil(CAST(0.2 AS DOUBLE) * n) AS held FROM r)
        SELECT pair_id, CASE WHEN rn < n - held THEN 'train' WHEN rn < n - ceil(held / 2) THEN 'val' ELSE 'test' END AS split
        FROM s""",
    "shuffle_rows": f"""WITH {LINES}
        SELECT pair_id, row_number() OVER (ORDER BY {HASH}, pair_id) - 1 AS rank FROM lines""",
    "rank_in_order": f"""WITH {LINES}
        SELECT pair_id, row_number() OVER (ORDER BY pair_id) - 1 AS rank, count(*) OVER () AS n_total FROM lines""",
    "orient_pairs": f"{MEASURED} SELECT pair_id, vi_normalized AS src, en_normalized AS tgt FROM measured",
    # Normalising takes the dirt back.
    "subword_text": f"WITH {LINES} SELECT doc_id * 4294967296 + i AS line_id, {squeezed('line')} AS text FROM l",
    "word_counts": f"WITH {WORDS} SELECT word, freq FROM words",
    "user_symbol_counts": f"""WITH {WORDS}
        SELECT symbol, count(*) AS freq FROM (
          SELECT unnest(regexp_extract_all('▁' || replace(text, ' ', '▁'),
            '{"|".join(t.replace(" ", "▁") for t in sorted(TERMS, key=lambda t: (-len(t), t)))}')) AS symbol
          FROM every WHERE text <> '') GROUP BY 1""",
    "forged_specials": f"""WITH {LINES}
        SELECT doc_id * 4294967296 + i AS line_id, {squeezed("'<s> a<s>b ' || line || ' </s> </s>b <pad><unk>'")} AS text FROM l""",
    "pair_counts": f"""WITH {WORDS}
        SELECT l, r, CAST(sum(freq) AS BIGINT) AS freq FROM (
          SELECT unnest(p[1:-2]) AS l, unnest(p[2:-1]) AS r, freq
          FROM (SELECT string_split(word, '') AS p, freq FROM words) WHERE len(p) > 1) GROUP BY 1, 2""",
    "char_counts": f"WITH {WORDS} SELECT piece, freq FROM chars",
    "top_pieces": f"WITH {WORDS} SELECT piece, freq FROM chars ORDER BY freq DESC, piece LIMIT 20",
    "bpe_merges": MERGES,
    "bpe_vocab_size": f"""WITH {WORDS}
        SELECT 'en' AS lang, least({CHAR_VOCAB}, 4 + (SELECT count(*) FROM chars)) AS n_pieces
        UNION ALL SELECT 'vi', least({CHAR_VOCAB}, 4 + {len(TERMS)} + (SELECT count(*) FROM chars))""",
    "encode_words": f"""WITH {ENCODED}
        SELECT pair_id, array_to_string(src_ids, ' ') AS src_ids, array_to_string(tgt_ids, ' ') AS tgt_ids,
               CAST(len(src_ids) AS INT) AS src_len, CAST(len(tgt_ids) AS INT) AS tgt_len FROM encoded""",
    "segment_words": f"""WITH {ENCODED}
        SELECT CAST(coalesce(id, 1) AS INT) AS id, CAST(sum(freq) AS BIGINT) AS n_used
        FROM chars LEFT JOIN vocab USING (piece) GROUP BY 1""",
    "decode_ids": f"""WITH {ENCODED},
        plain AS (SELECT pair_id, list_filter(tgt_ids, lambda x: x > 3) AS ids FROM encoded),
        table_ AS (SELECT list(piece ORDER BY id) AS pieces FROM vocab)
        SELECT pair_id, trim(replace(array_to_string(list_transform(ids, lambda x: pieces[x - 3]), ''), '▁', ' '), ' ') AS text,
               array_to_string(ids, ' ') AS plain_ids FROM plain, table_""",
    "batch_pad": by_batch(
        src="array_to_string(src, ' ')",
        tgt="array_to_string(tgt, ' ')",
        src_lengths="CAST(sl AS VARCHAR)",
        tgt_lengths="CAST(tl AS VARCHAR)",
    ),
    "batch_shape": f"""WITH {batched(f"{HASH}, pair_id")}
        SELECT batch_id, count(*) AS n_rows, CAST(max(sl) AS INT) AS src_width, CAST(max(tl) AS INT) AS tgt_width,
               CAST(sum(sl + tl) AS BIGINT) AS n_ids,
               round(1 - sum(sl + tl) / CAST(count(*) * (max(sl) + max(tl)) AS DOUBLE), 6) AS padding_share
        FROM padded GROUP BY batch_id""",
    "shift_targets": by_batch(
        decoder_input="array_to_string(tgt[1:-2], ' ')", label="array_to_string(tgt[2:-1], ' ')"
    ),
    "pad_masks": by_batch(
        src_mask="array_to_string(list_transform(src, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END), ' ')"
    ),
    "eval_sample": f"""WITH {LINES}
        SELECT pair_id, CAST(rn AS INT) AS sample_id, rn // 32 AS batch_id, CAST(rn % 32 AS INT) AS batch_pos
        FROM (SELECT pair_id, row_number() OVER (ORDER BY pair_id) - 1 AS rn FROM lines) WHERE rn // 32 * 32 < 100""",
    "pick_examples": f"""WITH {LINES}, r AS (SELECT pair_id, row_number() OVER (ORDER BY pair_id) - 1 AS rn FROM lines)
        SELECT pair_id, rn // 32 AS batch_id, CAST(rn % 32 AS INT) AS batch_pos FROM r
        WHERE rn % 32 < 3 ORDER BY rn LIMIT 10""",
    "tokens_13a": f"""WITH {scored(5)} SELECT sample_id, array_to_string({tokens("reference")}, ' ') AS tokens FROM scored""",
    "bleu_ngrams": f"WITH {scored(5)}, {bleu('scored')} SELECT n, matches, hyp_total, ref_total FROM totals",
    "bleu_corpus": f"WITH {scored(5)}, {bleu('scored')} {ROUNDED}",
    "epoch_mean": """SELECT event_type AS run, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INT) AS epoch,
        round(avg(value), 6) AS mean_loss, count(*) AS n_steps FROM events GROUP BY 1, 2""",
    "best_so_far": f"WITH {BEST} SELECT run, epoch, val_loss, earlier_best, improved FROM best",
    "patience": f"WITH {WAITED} SELECT run, epoch, improved, waited FROM waited",
    "early_stop": f"""WITH {WAITED},
        s AS (SELECT *, min(CASE WHEN waited >= 5 THEN epoch END) OVER (PARTITION BY run) AS stop_epoch FROM waited)
        SELECT run, max(stop_epoch) AS stop_epoch, max(CASE WHEN improved THEN epoch END) AS best_epoch,
               min(val_loss) AS best_val_loss FROM s WHERE epoch <= coalesce(stop_epoch, epoch) GROUP BY run""",
    "run_summary": f"""WITH {METRICS} SELECT run, min(val_loss) AS min_val_loss, arg_max(val_loss, epoch) AS last_val_loss,
        count(*) AS epochs FROM log GROUP BY run""",
    "compare_epochs": f"""WITH {METRICS}
        SELECT epoch, a.val_loss AS {FIRST_RUN}_val_loss, b.val_loss AS {SECOND_RUN}_val_loss
        FROM (SELECT * FROM log WHERE run = '{FIRST_RUN}') a
        FULL JOIN (SELECT * FROM log WHERE run = '{SECOND_RUN}') b USING (epoch)""",
    "verdict_by_loss": f"""WITH {METRICS}
        SELECT CASE WHEN (SELECT min(val_loss) FROM log WHERE run = '{FIRST_RUN}')
                       < (SELECT min(val_loss) FROM log WHERE run = '{SECOND_RUN}')
                    THEN '{FIRST_RUN}' ELSE '{SECOND_RUN}' END AS winner""",
    "verdict_by_bleu": f"""WITH
        a AS (WITH {scored(5)}, {bleu("scored")} SELECT bleu FROM score),
        b AS (WITH {scored(3)}, {bleu("scored")} SELECT bleu FROM score)
        SELECT CASE WHEN a.bleu > b.bleu THEN 'fifth' WHEN b.bleu > a.bleu THEN 'third' ELSE 'tie' END AS winner FROM a, b""",
    "compare_translations": f"""WITH {scored(5, "a")}, {scored(3, "b")}
        SELECT sample_id, a.source, a.reference, a.translation AS fifth, b.translation AS third
        FROM a JOIN b USING (sample_id)""",
    "head_translations": f"""WITH {scored(5, "a")}, {scored(3, "b")}
        SELECT sample_id, a.source, a.reference, a.translation AS fifth, b.translation AS third
        FROM a JOIN b USING (sample_id) ORDER BY sample_id LIMIT 3""",
    "translate_batches": f"""WITH {scored(5)}
        SELECT sample_id, array_to_string(list_reverse(string_split(source, ' ')), ' ') AS translation FROM scored""",
    "evaluate_run_score": f"WITH {EVALUATED}, {bleu('sample')} {ROUNDED}",
    "evaluate_run_examples": f"""WITH {EVALUATED} SELECT CAST(sample_id AS INT) AS sample_id, source, reference, translation
        FROM sample WHERE sample_id % 32 < 3 ORDER BY sample_id LIMIT 10""",
    "lookup_pieces": f"""WITH {ENCODED}
        SELECT CAST(coalesce(v.id, 1) AS INT) AS id, CAST(sum(freq) AS BIGINT) AS n_used,
               coalesce(any_value(v.piece), '<unk>') AS piece
        FROM chars c LEFT JOIN vocab v ON v.piece = c.piece GROUP BY 1""",
    "tsv_round_trip": f"""WITH {LINES},
        p AS (SELECT string_split(regexp_replace(regexp_replace(en || chr(9) || vi, '^{SPACE}', ''), '{SPACE}$', ''), chr(9)) AS p
              FROM lines)
        SELECT p[1] AS en, p[2] AS vi FROM p WHERE len(p) >= 2""",
    "csv_files": f"""WITH {TURNS} SELECT en, vi, NULL AS malformed_record FROM turns
        UNION ALL SELECT NULL, NULL, CAST(pair_id AS VARCHAR) || ',a,"b, c"' FROM turns""",
    "csv_literal_quotes": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
        SELECT CAST(doc_id * 4294967296 + i AS VARCHAR) || '" by 5" pipe' AS en,
               'a "' || line || '"' || chr(10) || chr(10) || 'b' AS vi, ' 7" disc' AS size, 'q tail"' AS note,
               CAST(NULL AS VARCHAR) AS malformed_record FROM l""",
    "csv_round_trip": f"WITH {TURNS} SELECT en, vi, 'talk' AS topic FROM turns",
    "splits_round_trip": f"""WITH {LINES}, unique_lines AS {DEDUP.format("lines")}, {measured("unique_lines")}, {kept()}
        SELECT pair_id, en, vi_normalized, length_ratio, {SPLIT} AS split FROM kept JOIN unique_lines USING (pair_id)""",
    "prepare_counts": f"""WITH {PREPARED},
        reasons AS (SELECT {reason()} AS stage FROM measured
                    UNION ALL SELECT {TEXT_SPLIT} FROM kept JOIN raw USING (pair_id))
        SELECT stage, count(r.stage) AS n_rows
        FROM (SELECT unnest(['missing_text', 'en_short', 'en_long', 'vi_short', 'vi_long', 'ratio_undefined', 'ratio_high',
                             'ratio_low', 'kept', 'train', 'val', 'test']) AS stage) LEFT JOIN reasons r USING (stage) GROUP BY stage""",
    "prepare_splits": f"""WITH {PREPARED}
        SELECT en, vi, vi_normalized, length_ratio, {TEXT_SPLIT} AS split FROM kept JOIN raw USING (pair_id)""",
    "ragged_patience": f"""WITH {RAGGED} SELECT run, epoch, earlier_best, improved, waited FROM waited""",
    "ragged_early_stop": f"""WITH {RAGGED},
        s AS (SELECT *, min(CASE WHEN waited >= 5 THEN epoch END) OVER (PARTITION BY run) AS stop_epoch FROM waited)
        SELECT run, max(stop_epoch) AS stop_epoch, max(CASE WHEN improved THEN epoch END) AS best_epoch,
               min(val_loss) AS best_val_loss FROM s WHERE epoch <= coalesce(stop_epoch, epoch) GROUP BY run""",
    "ragged_epochs": f"""WITH {RAGGED}
        SELECT epoch, a.train_loss AS {FIRST_RUN}_train_loss, a.val_loss AS {FIRST_RUN}_val_loss,
               b.train_loss AS {SECOND_RUN}_train_loss, b.val_loss AS {SECOND_RUN}_val_loss
        FROM (SELECT * FROM log WHERE run = '{FIRST_RUN}' AND epoch > 1) a
        FULL JOIN (SELECT * FROM log WHERE run = '{SECOND_RUN}' AND epoch > 1) b USING (epoch)""",
    "verdict_without_a_run": f"SELECT unnest(['{FIRST_RUN}', '{SECOND_RUN}', NULL]) AS winner FROM (SELECT count(*) FROM events)",
    "vocab_round_trip": f"""WITH {ENCODED}
        SELECT 'en' AS lang, CAST(id AS INT) AS id, piece, freq, 'char' AS kind FROM vocab JOIN chars USING (piece)
        UNION ALL SELECT 'en', CAST(k - 1 AS INT), names[k], 0, 'special'
        FROM (SELECT ['<pad>', '<unk>', '<s>', '</s>'] AS names, unnest([1, 2, 3, 4]) AS k)""",
}
for copy, original in (
    ("epoch_comparison_file", "compare_epochs"),
    ("translation_comparison_file", "compare_translations"),
    ("compare_stored_runs", "compare_translations"),
    ("resumed_translations", "translate_batches"),
):
    ORACLES[copy] = ORACLES[original]
