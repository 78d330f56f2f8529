"""DuckDB SQL that the queries must agree with, written from the contracts and not from the Spark plans."""

from __future__ import annotations

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Fixed values of the quality rules: metric, numerator, denominator, scale, thousandths of a group that may be rejected.
_METRICS = [
    ("word_length", "word_chars", "n_words", 100, 100),
    ("symbol_share", "n_symbols", "word_chars", 1000, 100),
    ("dup_line_share", "n_dup_lines", "n_lines", 1000, 10),
    ("repeat_share", "n_repeat_words", "n_words", 1000, 10),
]


def _quality_ctes() -> str:
    share = "\nUNION ALL ".join(
        f"SELECT doc_id, lang, source, base_failed, '{m}' metric, {part} share, CASE WHEN {d} > 0 THEN ({scale} * {n}) // {d} ELSE 0 END v FROM base"
        for m, n, d, scale, part in _METRICS)

    def fence(name: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        return f"""
    {name}_b AS (SELECT *, sum(n) OVER (PARTITION BY {by}metric ORDER BY top) upto, sum(n) OVER (PARTITION BY {by}metric) total
      FROM (SELECT {by}metric, top, bottom, max(share) share, count(*) n FROM bucketed GROUP BY {by}metric, top, bottom)),
    {name}_q AS (SELECT {by}metric, max(total) n_rows, min(CASE WHEN 4 * upto >= total THEN top END) q1, min(CASE WHEN 4 * upto >= 3 * total THEN top END) q3,
      min(CASE WHEN 1000 * upto >= (1000 - share) * total THEN top END) high, min(CASE WHEN 1000 * upto > share * total THEN bottom END) low
      FROM {name}_b GROUP BY {by}metric),
    {name}_f AS (SELECT {by}metric, n_rows, greatest(q3 + 3 * (q3 - q1), high) above, least(q1 - 3 * (q3 - q1), low) below FROM {name}_q),
    {name} AS (SELECT {", ".join(f"f.{k}" for k in keys.split(", ")) + ", " if keys else ""}f.metric, max(n_rows) n_rows,
        coalesce((max(CASE WHEN top <= above THEN top END) + min(CASE WHEN top > above THEN bottom END) - 1) // 2, max(above)) most,
        CASE WHEN f.metric = 'word_length' THEN
          coalesce((min(CASE WHEN bottom >= below THEN bottom END) + max(CASE WHEN bottom < below THEN top END)) // 2 + 1, max(below)) END least
      FROM {name}_f f JOIN {name}_b b ON f.metric = b.metric{"".join(f" AND f.{k} IS NOT DISTINCT FROM b.{k}" for k in keys.split(", ") if k)}
      GROUP BY {", ".join(f"f.{k}" for k in keys.split(", ")) + ", " if keys else ""}f.metric)"""

    def limit(column: str) -> str:
        return f"coalesce(CASE WHEN own.n_rows >= 50 THEN own.{column} END, CASE WHEN up.n_rows >= 50 THEN up.{column} END, overall.{column}, 0)"

    return f"""
    split AS (SELECT doc_id, lang, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') words FROM documents),
    windows AS (SELECT doc_id, unnest(range(1, len(words) - 3)) i, unnest(list_transform(range(1, len(words) - 3), lambda i: md5(array_to_string(words[i:i + 4], ' ')))) g FROM split WHERE len(words) >= 5),
    grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) n FROM windows),
    repeated AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest(range(i, i + 5)) p FROM grams WHERE n > 1) GROUP BY doc_id),
    lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(t, chr(10))) line FROM split) WHERE trim(line, {_BLANKS}) <> ''),
    counted AS (SELECT doc_id, count(*) n, count(*) - count(DISTINCT line) dup FROM lines GROUP BY doc_id),
    base AS (
      SELECT s.doc_id, lang, source, len(words) n_words, length(array_to_string(words, '')) word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, coalesce(c.n, 0) n_lines, coalesce(c.dup, 0) n_dup_lines, coalesce(r.n, 0) n_repeat_words,
        len(words) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(words) AS base_failed
      FROM split s LEFT JOIN repeated r USING (doc_id) LEFT JOIN counted c USING (doc_id)),
    valued AS ({share}),
    bucketed AS (
      SELECT *, CASE WHEN v < 64 THEN v ELSE (v >> s) << s END bottom, CASE WHEN v < 64 THEN v ELSE (((v >> s) + 1) << s) - 1 END top
      FROM (SELECT *, greatest(length(bin(v)) - 6, 0) s FROM valued WHERE NOT base_failed)),
    {fence("own", "lang, source")}, {fence("up", "lang")}, {fence("overall", "")},
    verdict AS (
      SELECT v.doc_id, NOT bool_or(v.base_failed) AND bool_and(v.v <= {limit("most")} AND (v.metric <> 'word_length' OR v.v >= {limit("least")})) kept
      FROM valued v LEFT JOIN own ON own.lang IS NOT DISTINCT FROM v.lang AND own.source IS NOT DISTINCT FROM v.source AND own.metric = v.metric
        LEFT JOIN up ON up.lang IS NOT DISTINCT FROM v.lang AND up.metric = v.metric LEFT JOIN overall ON overall.metric = v.metric
      GROUP BY v.doc_id)"""


def quality_rules() -> str:
    return f"""WITH {_quality_ctes()}
    SELECT doc_id, n_words::BIGINT n_words, word_chars::BIGINT word_chars, n_symbols::BIGINT n_symbols, n_dup_lines::BIGINT n_dup_lines,
      n_repeat_words::BIGINT n_repeat_words, base_failed, kept FROM base JOIN verdict USING (doc_id)"""


def line_dedup(table: str, min_sites: int = 10) -> str:
    return f"""WITH
    placed AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) place FROM {table}),
    lines AS (SELECT *, trim(line, {_BLANKS}) bare FROM placed),
    shared AS (SELECT bare FROM lines WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT coalesce(source, chr(0))) >= {min_sites}),
    numbered AS (SELECT l.*, s.bare IS NOT NULL AND row_number() OVER (PARTITION BY l.bare ORDER BY doc_id, place) > 1 gone
                 FROM lines l LEFT JOIN shared s ON s.bare = l.bare),
    rebuilt AS (SELECT doc_id, count(*) FILTER (bare <> '') n_lines, count(*) FILTER (gone) n_removed,
                  coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') new_text FROM numbered GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT n_lines, coalesce(n_removed, 0)::BIGINT n_removed,
      CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(new_text, d.text)) END text_sha256
    FROM {table} d LEFT JOIN rebuilt USING (doc_id)"""


WARC = """WITH p AS (SELECT page_id, coalesce(html, '') h, sha256(coalesce(html, '')) payload_digest FROM pages),
    f AS (SELECT payload_digest, min(page_id) first_id FROM p WHERE strlen(h) >= 100 GROUP BY payload_digest)
    SELECT page_id, strlen(h)::BIGINT payload_bytes, payload_digest,
      CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END record_type, CASE WHEN page_id > first_id THEN first_id END refers_to
    FROM p LEFT JOIN f USING (payload_digest)"""

JACCARD = """WITH RECURSIVE
    words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w FROM documents),
    grams AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i FROM words WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) n FROM grams GROUP BY doc_id),
    pairs AS (SELECT a.doc_id x, b.doc_id y, count(*) n FROM grams a JOIN grams b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * pairs.n >= 75 * (s.n + t.n - pairs.n)),
    edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach AS (SELECT doc_id, doc_id r FROM documents UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON edges.x = reach.r)
    SELECT d.doc_id, coalesce(s.n, 0)::BIGINT n_shingles, c.component_id, coalesce(e.n, 0)::BIGINT n_links
    FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT x doc_id, count(*) n FROM edges GROUP BY x) e USING (doc_id) JOIN (SELECT doc_id, min(r) component_id FROM reach GROUP BY doc_id) c USING (doc_id)"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes; ``crc_table`` has to be among the relations read."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, crc_of_byte[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


_CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY b) crc_of_byte FROM (
      SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) c FROM range(256) t(b)))"""

INTERLEAVED = f"""WITH {_CRC_TABLE},
    named AS (SELECT doc_id, source, coalesce(text, '') t, md5('42:' || doc_id) h FROM documents),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 k, count(*) OVER (PARTITION BY source) n FROM named),
    placed AS (SELECT *, row_number() OVER (ORDER BY (2 * k + 1)::DOUBLE / (2 * n), source NULLS FIRST, h, doc_id) - 1 p, count(*) OVER () total FROM ranked),
    cut AS (SELECT *, (24 * p) // total shard FROM placed)
    SELECT doc_id, (strlen(t) + 8)::BIGINT size, {_crc32("t")} text_crc32, 'rows' law, shard::INTEGER shard,
      (row_number() OVER (PARTITION BY shard ORDER BY p) - 1)::BIGINT slot, NULL::INTEGER grown_shard
    FROM cut, crc_table"""

_FEATURES = """SELECT {key}, unnest(list_transform(w, lambda x, i: x) || list_transform(w[2:], lambda x, i: w[i] || ' ' || x)
      || list_transform(w[3:], lambda x, i: w[i] || ' ' || w[i + 1] || ' ' || x)) f
    FROM (SELECT *, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM {table})"""

IMPORTANCE = f"""WITH {_CRC_TABLE},
    own AS ({_FEATURES.format(key="doc_id", table="documents")}), wanted AS ({_FEATURES.format(key="item_id", table="benchmark")}),
    hashed AS (SELECT f, {_crc32("f")} % 10000 bucket FROM (SELECT f FROM own UNION SELECT f FROM wanted), crc_table),
    counted AS (SELECT doc_id, bucket, count(*) n FROM own JOIN hashed USING (f) GROUP BY doc_id, bucket),
    s AS (SELECT bucket, sum(n) s FROM counted GROUP BY bucket), t AS (SELECT bucket, count(*) t FROM wanted JOIN hashed USING (f) GROUP BY bucket),
    gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE
        / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT g
      FROM (SELECT unnest(range(10000)) bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
    weighed AS (SELECT doc_id, sum(n)::BIGINT n_features, sum(n * g)::BIGINT weight FROM counted JOIN gains USING (bucket) GROUP BY doc_id),
    scored AS (SELECT doc_id, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
        (('0x' || left(sha256('42:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT score,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) >= 20 fit
      FROM documents LEFT JOIN weighed USING (doc_id)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) r FROM scored)
    SELECT doc_id, n_features::BIGINT n_features, weight, score, CASE WHEN fit AND r <= (SELECT 5 * count(*) // 100 FROM scored WHERE fit) THEN r END AS "rank" FROM ranked"""
