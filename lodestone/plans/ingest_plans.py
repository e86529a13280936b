"""Queries over lines, elements and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..operators import chunking, indexing, ingest, search
from ..session import run_folder, table
from ..sources import index
from ..sources import pages as page_files
from . import inputs
from .registry import query

STRIP = r"regexp_replace({x}, '^[\x09-\x0D ]+|[\x09-\x0D ]+$', '', 'g')"
HEADING = r"""CASE WHEN length(text) > 120 THEN false WHEN regexp_matches(text, '(?i)^\d{1,2}\s+(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\.?\s*$') THEN false
    WHEN regexp_matches(text, '^(\d{1,3}[A-Z]?(\.\d{1,3}){0,3})[\.\)]?\s+\S') THEN true ELSE size >= body * 1.15 END"""
BODY = "SELECT doc_id, list_sort(list(size))[len(list(size)) // 2 + 1] AS body FROM lines WHERE size > 0 GROUP BY doc_id"
JOIN_LINES = r"list_reduce({l}, lambda a, x: CASE WHEN a = '' THEN x WHEN regexp_matches(a, '[\p{{L}}\p{{N}}_]-$') THEN substr(a, 1, length(a) - 1) || x ELSE a || ' ' || x END)"


@query(f"SELECT doc_id, page, line_no, text FROM (SELECT doc_id, {inputs.PAGE} AS page, l AS line_no, {STRIP.format(x='raw')} AS text FROM raw_lines) WHERE text <> ''")
def lines_extract(spark, sf_dir):
    return ingest.extract_lines(table(spark, sf_dir, "documents"))


def _by_source(spark, sf_dir):
    lines = inputs.raw_lines(spark, sf_dir).select("source", "doc_id", F.col("l").alias("line_no"), F.col("raw").alias("text"))
    pages = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return lines, ingest.boilerplate_lines(lines, "source", "doc_id", pages, 0.1)


BOILERPLATE = """SELECT source, raw AS text, count(DISTINCT doc_id) AS n_pages FROM raw_lines JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) USING (source)
    GROUP BY source, raw, n HAVING count(DISTINCT doc_id) >= greatest(2, floor(n * 0.1))"""


@query(BOILERPLATE)
def boilerplate_lines(spark, sf_dir):
    return _by_source(spark, sf_dir)[1]


@query(f"SELECT source, doc_id, l AS line_no, raw AS text FROM raw_lines r WHERE NOT EXISTS (SELECT 1 FROM ({BOILERPLATE}) b WHERE b.source = r.source AND b.text = r.raw)")
def boilerplate_strip(spark, sf_dir):
    lines, found = _by_source(spark, sf_dir)
    return ingest.strip_boilerplate(lines, found, "source")


CONTENTS = r"SELECT doc_id, page FROM lines GROUP BY doc_id, page HAVING avg(CASE WHEN regexp_matches(text, '\.{4,}\s*\d{1,4}\s*$') THEN 1 ELSE 0 END) >= 0.3"


@query(CONTENTS)
def toc_pages(spark, sf_dir):
    return ingest.contents_pages(inputs.lines(spark, sf_dir))


@query("SELECT doc_id, list_sort(list(n))[len(list(n)) // 2 + 1] AS middle FROM (SELECT doc_id, CAST(length(raw) AS BIGINT) AS n FROM raw_lines) GROUP BY doc_id")
def upper_median(spark, sf_dir):
    sized = inputs.raw_lines(spark, sf_dir).select("doc_id", F.length("raw").cast("long").alias("n"))
    return stats.upper_median(sized, ["doc_id"], "n", "middle")


FLAGGED = f"SELECT doc_id, page, line_no, text, size, {HEADING} AS heading FROM lines JOIN ({BODY}) USING (doc_id)"


@query(FLAGGED)
def heading_flags(spark, sf_dir):
    lines = inputs.lines(spark, sf_dir)
    return ingest.heading_flags(lines, ingest.body_sizes(lines))


def assembled(flagged: str) -> str:
    return f"""SELECT doc_id, page, min(line_no) AS line_no, CASE WHEN heading THEN 'heading' ELSE 'paragraph' END AS kind, {JOIN_LINES.format(l='list(text ORDER BY line_no)')} AS text
        FROM (SELECT *, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island FROM ({flagged})) GROUP BY doc_id, page, island, heading"""


@query(assembled(FLAGGED))
def paragraphs(spark, sf_dir):
    lines = inputs.lines(spark, sf_dir)
    return ingest.assemble(ingest.heading_flags(lines, ingest.body_sizes(lines)))


@query(f"SELECT doc_id, {JOIN_LINES.format(l='list(text ORDER BY line_no)')} AS text FROM lines GROUP BY doc_id")
def dehyphenate(spark, sf_dir):
    grouped = inputs.lines(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return grouped.select("doc_id", T.dehyphenated(F.col("l.text")).alias("text"))


PAGE_COUNTS = f"SELECT doc_id, CAST(max({inputs.PAGE}) AS BIGINT) AS n FROM raw_lines GROUP BY doc_id"
KEPT = f"""SELECT * FROM lines l WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, text FROM lines JOIN ({PAGE_COUNTS}) USING (doc_id)
    GROUP BY doc_id, text, n HAVING count(DISTINCT page) >= greatest(2, floor(n * 0.4))) b WHERE b.doc_id = l.doc_id AND b.text = l.text)"""


@query(f"""WITH kept AS ({KEPT}), toc AS ({CONTENTS.replace('FROM lines', 'FROM kept')}),
    own AS (SELECT * FROM kept k WHERE NOT EXISTS (SELECT 1 FROM toc WHERE toc.doc_id = k.doc_id AND toc.page = k.page))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no) AS elem_no, kind, text, page FROM ({assembled(FLAGGED.replace('FROM lines JOIN', 'FROM own JOIN'))})""")
def elements(spark, sf_dir):
    lines = inputs.lines(spark, sf_dir)
    return ingest.elements(lines, lines.groupBy("doc_id").agg(F.max("page").cast("long").alias("n")))


OCR = "concat(CASE WHEN doc_id % 2 = 0 THEN '4.1 Scope' ELSE '' END, {nl}, ' ', {nl}, text, {nl}, {nl}, '7. End')"


@query(rf"""WITH blocks AS (SELECT doc_id, generate_subscripts(b, 1) AS k, unnest(b) AS block FROM (SELECT doc_id, regexp_split_to_array({OCR.format(nl='chr(10)')}, '\n\s*\n') AS b FROM documents)),
    own AS (SELECT doc_id, k, list_filter(list_transform(string_split(block, chr(10)), lambda x: {STRIP.format(x='x')}), lambda x: x <> '') AS l FROM blocks)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS elem_no,
    CASE WHEN len(l) = 1 AND length(l[1]) < 100 AND regexp_matches(l[1], '^(\d{{1,3}}[A-Z]?(\.\d{{1,3}}){{0,3}})[\.\)]?\s+\S') THEN 'heading' ELSE 'paragraph' END AS kind, {JOIN_LINES.format(l='l')} AS text, CAST(1 AS INT) AS page FROM own WHERE len(l) > 0""")
def ocr_elements(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").selectExpr("doc_id", "1 AS page", f"{OCR.format(nl='char(10)')} AS text")
    return ingest.ocr_elements(pages)


@query("SELECT doc_id, CAST(len(w) AS BIGINT) AS tokens FROM word_lists")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CASE WHEN len(w) <= 32 THEN text ELSE array_to_string(w[len(w) - 31:], ' ') END AS tail FROM word_lists")
def overlap_tail(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.overlap_tail(F.col("text"), 32).alias("tail"))


@query(r"SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS sentence_no, unnest(s) AS sentence FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)")
def sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", T.SENTENCE_GAP)).alias("sentence_no", "sentence"))


@query("""SELECT doc_id, CAST(i AS INT) AS window_no, array_to_string(w[i * 80 + 1 : i * 80 + 100], ' ') AS words FROM
    (SELECT doc_id, w, unnest(generate_series(0, greatest(CAST(ceil((len(w) - 100) / 80) AS INT), 0))) AS i FROM word_lists WHERE len(w) > 0)""")
def token_windows(spark, sf_dir):
    windows = T.token_windows(F.col("text"), 100, 20)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(windows).alias("window_no", "words"))


@query("SELECT doc_id, sha256(concat(doc_id, ':', 1, ':', 1 + doc_id % 3, ':', CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END, ':', text)) AS chunk_hash FROM documents")
def chunk_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("section", F.expr("if(doc_id % 2 = 0, lang, null)"))
    return docs.select("doc_id", T.chunk_hash(F.col("doc_id"), F.lit(1), F.expr("1 + doc_id % 3"), F.col("section"), F.col("text")).alias("chunk_hash"))


@query()
def chunks_pack(spark, sf_dir):
    """The packer is a state machine; tests hold it against hand cases."""
    return chunking.pack_chunks(elements(spark, sf_dir))


def _two_counts() -> chunking.Packer:
    import public_tokenizers

    model = chunking.FileTokenizer(public_tokenizers.path("byte_bpe_50k.json"), special=1)
    return chunking.Packer(model, target=240, overlap=32, exact=True, sizes=chunking.WordCounter())


@query()
def chunks_by_model(spark, sf_dir):
    """Chunks that fit a model, with its token counts and the plain ones; tests hold it against a second implementation over whole tables."""
    return chunking.pack_chunks(elements(spark, sf_dir), _two_counts)


GARBAGE = r"(len(w) < 40 OR length(text) = 0 OR length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) / length(text) < 0.5)"


@query(f"SELECT doc_id FROM word_lists WHERE {GARBAGE}")
def garbage_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where(chunking.is_garbage(F.col("text"), T.token_count(F.col("text")))).select("doc_id")


@query("SELECT sha256(text) AS chunk_hash, max(doc_id) AS doc_id FROM documents GROUP BY ALL")
def chunk_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("chunk_hash"))
    return chunking.latest_by_hash(docs, "chunk_hash", "doc_id")


@query("SELECT count(*) AS chunks, CAST(sum(CASE WHEN len(w) > 256 THEN 1 ELSE 0 END) AS BIGINT) AS truncated FROM word_lists")
def truncated_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(T.token_count(F.col("text")).alias("tokens"))
    return indexing.truncated(docs, "tokens", 256)


@query(f"""SELECT source, count(*) AS chunks, CAST(min(len(w)) AS BIGINT) AS least, CAST(list_sort(list(len(w)))[count(*) // 2 + 1] AS BIGINT) AS middle, CAST(max(len(w)) AS BIGINT) AS most,
    CAST(sum(CASE WHEN length(text) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty, CAST(sum(CASE WHEN {GARBAGE} THEN 1 ELSE 0 END) AS BIGINT) AS garbage FROM word_lists GROUP BY source""")
def chunk_quality(spark, sf_dir):
    tokens = T.token_count(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("source", "text", tokens.alias("tokens"), chunking.is_garbage(F.col("text"), tokens).cast("long").alias("g"))
    figures = docs.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.min("tokens").alias("least"), F.max("tokens").alias("most"), F.sum((F.length("text") == 0).cast("long")).alias("empty"), F.sum("g").alias("garbage"))
    return figures.join(stats.upper_median(docs, ["source"], "tokens", "middle"), "source")


QUALITY = f"""count(*) AS chunks, coalesce(CAST(min(len(w)) AS BIGINT), 0) AS least, coalesce(CAST(list_sort(list(len(w)))[count(*) // 2 + 1] AS BIGINT), 0) AS middle, coalesce(CAST(max(len(w)) AS BIGINT), 0) AS most,
    CAST(count(*) FILTER (length(text) = 0) AS BIGINT) AS empty, CAST(count(*) FILTER ({GARBAGE}) AS BIGINT) AS garbage FROM word_lists"""


@query(f"SELECT false AS whole, source, {QUALITY} GROUP BY source UNION ALL SELECT true, NULL, {QUALITY}")
def quality_report(spark, sf_dir):
    """Chunk quality by source and in all, from one scan."""
    docs = table(spark, sf_dir, "documents").withColumn("token_count", T.token_count(F.col("text")))
    return chunking.quality(docs, "source")


@query(f"SELECT doc_id, replace(substr(text, 1, 120), chr(10), ' ') AS preview FROM word_lists WHERE {GARBAGE} ORDER BY doc_id LIMIT 15")
def garbage_previews(spark, sf_dir):
    """A report of the first fifteen; the limit is the feature."""
    docs = table(spark, sf_dir, "documents")
    found = docs.where(chunking.is_garbage(F.col("text"), T.token_count(F.col("text"))))
    return found.orderBy("doc_id").limit(15).select("doc_id", F.translate(F.substring("text", 1, 120), "\n", " ").alias("preview"))


@query("""SELECT CAST(least(floor((n - lo) / CAST(hi - lo AS DOUBLE) * 30), 29) AS BIGINT) AS bin, count(*) AS n FROM
    (SELECT len(w) AS n FROM word_lists) CROSS JOIN (SELECT min(len(w)) AS lo, max(len(w)) AS hi FROM word_lists) GROUP BY 1""")
def token_histogram(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "documents").select(T.token_count(F.col("text")).alias("tokens")), "tokens")


GREP = r"(?i)(the\s+of|de\s+la)"


@query(rf"""SELECT doc_id, page, regexp_replace(substr(t, greatest(length(before) - 79, 1), least(length(before), 80) + length(hit) + 80), '[\x09-\x0D ]+', ' ', 'g') AS snippet FROM
    (SELECT doc_id, page, t, hit, substr(t, 1, strpos(t, hit) - 1) AS before FROM (SELECT doc_id, page, t, regexp_extract(t, '{GREP}') AS hit FROM
    (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY line_no) AS t FROM lines GROUP BY doc_id, page)) WHERE hit <> '') ORDER BY doc_id, page LIMIT 30""")
def corpus_grep(spark, sf_dir):
    """One hit a page, the first thirty in order; the limit is the feature."""
    pages = inputs.lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "text")))["text"], "\n").alias("t"))
    found = pages.withColumn("hit", F.regexp_extract("t", GREP, 0)).where("hit <> ''").withColumn("at", F.instr("t", F.col("hit")))
    start = F.greatest(F.col("at") - 80, F.lit(1))
    snippet = F.regexp_replace(F.substring(F.col("t"), start, F.least(F.col("at") - 1, F.lit(80)) + F.length("hit") + 80), T.SPACE, " ")
    return found.select("doc_id", "page", snippet.alias("snippet")).orderBy("doc_id", "page").limit(30)


#: Metacharacters, a space over a line end, any case, letters beyond ASCII, a phrase that is nowhere.
PHRASES = ["the OF", "de la", "Licensed under the", "(c)", "für", "a.b*c", "no such phrase"]
ORDER = "CAST(doc_id % 97 * 100000000 + doc_id AS BIGINT)"


def _first_hits_sql() -> str:
    one = r"""SELECT doc_id, page, '{phrase}' AS phrase, trim(regexp_replace(substr(t, greatest(b - 80, 0) + 1, least(b, 80) + h + 80), '{blank}+', ' ', 'g')) AS snippet FROM
        (SELECT doc_id, page, t, length(regexp_extract(t, '(?s)\A(.*?)((?i:{pattern}))', 1)) AS b, length(regexp_extract(t, '(?i){pattern}')) AS h FROM cut WHERE regexp_matches(t, '(?i){pattern}') ORDER BY manifest_ord, page LIMIT 30)"""
    return f"""WITH cut AS (SELECT doc_id, {ORDER} AS manifest_ord, CAST(i + 1 AS INT) AS page, array_to_string(w[i * 5 + 1 : i * 5 + 5], chr(10)) AS t FROM
        (SELECT doc_id, w, unnest(generate_series(0, CAST(floor((len(w) - 1) / 5) AS INT))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents)))
        """ + " UNION ALL ".join(f"SELECT * FROM ({one.format(phrase=p, pattern=T.phrase_pattern(p), blank=T.BLANK)})" for p in PHRASES)


@query(_first_hits_sql())
def phrase_search(spark, sf_dir):
    """Several phrases over whole documents in pages of five lines, in an order that isn't that of ids."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.expr(ORDER).alias("manifest_ord"), F.split("text", "\n").alias("w"))
    numbers = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 5).cast("int"))
    cut = lines.where("w IS NOT NULL").select("manifest_ord", "doc_id", F.posexplode(F.transform(numbers, lambda i: F.array_join(F.slice("w", i * 5 + 1, 5), "\n"))).alias("n", "text"))
    pages = page_files.write_pages(cut.select("manifest_ord", "doc_id", (F.col("n") + 1).alias("page"), "text"), run_folder(spark, "pages"))
    return search.first_hits(pages, PHRASES).drop("manifest_ord")


@query("""SELECT h AS chunk_hash, CASE WHEN NOT bool_or(old) THEN 'add' WHEN NOT bool_or(new) THEN 'delete' ELSE 'keep' END AS action FROM
    (SELECT sha256(text) AS h, true AS new, false AS old FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT sha256(text), false, true FROM documents WHERE doc_id % 4 > 0) GROUP BY h""")
def index_diff(spark, sf_dir):
    """Two versions of a corpus, made by leaving documents out of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("chunk_hash"))
    return indexing.index_diff(docs.where("doc_id % 3 > 0"), docs.where("doc_id % 4 > 0"))




# Three states of a corpus: a tenth of the documents missing; then a tenth rewritten, another tenth dropped, the missing ones there; then the dropped ones back.
STATES = ("doc_id % 10 <> 5", "doc_id % 10 <> 7", "true")
TEXT_OF = ("text", "CASE WHEN doc_id % 10 = 3 THEN concat('New: ', text) ELSE text END", "CASE WHEN doc_id % 10 = 3 THEN concat('New: ', text) ELSE text END")


@query(f"""WITH a AS (SELECT DISTINCT sha256({TEXT_OF[0]}) AS h FROM documents WHERE {STATES[0]}), b AS (SELECT DISTINCT sha256({TEXT_OF[1]}) AS h FROM documents WHERE {STATES[1]}),
    c AS (SELECT sha256({TEXT_OF[2]}) AS h, max(doc_id) AS doc_id, any_value({TEXT_OF[2]}) AS t FROM documents WHERE {STATES[2]} GROUP BY 1)
    SELECT h AS chunk_hash, length(t) AS n_chars, h IN (SELECT h FROM b) AS kept_since_second, h IN (SELECT h FROM a) AND h IN (SELECT h FROM b) AS kept_since_first FROM c""")
def index_delta(spark, sf_dir):
    """An index brought through three states of the corpus by what changed: what it holds in the end, and by which part."""
    docs = table(spark, sf_dir, "documents")
    folder = run_folder(spark, "index")
    for state, text in zip(STATES, TEXT_OF, strict=True):
        own = docs.where(state).select("doc_id", F.expr(text).alias("text"))
        chunks = own.select(F.sha2("text", 256).alias("chunk_hash"), F.col("doc_id").alias("position"), "doc_id", "text")
        index.rebuild(chunks, folder, lambda rows: rows.select("chunk_hash", F.length("text").cast("long").alias("n_chars")), {"embedder": "length", "target": 240})
    part = F.col("_part")
    # Each state's part is its number: what the third brought was in neither kept set.
    rows = index.parts(spark, folder)
    return rows.select("chunk_hash", "n_chars", (part < 3).alias("kept_since_second"), (part < 2).alias("kept_since_first"))
