import corpus_pipeline
from test_language_id import decoded
from test_line_dedup import key
from test_near_dedup import brute as near_groups
from test_tokens import check_packed
from tokenizers import Tokenizer

from lodestone.llm import language_id
from lodestone.llm.common import documents
from lodestone.llm.secrets import redact
from lodestone.llm.tokens import default_vocabulary


def lines(rows):
    holders = {}
    for i, t in rows:
        for k in {key(x) for x in t.split("\n")}:
            if len(k) >= 20:
                holders.setdefault(k, []).append(i)
    gone = {k: max(h) for k, h in holders.items() if len(h) >= 3}
    return [(i, "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i)) for i, t in rows]


def test_pipeline_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    model = language_id.train(documents(spark, sf_dir))
    rows = lines([(i, t) for i, t in rows if language_id.is_told(*decoded(model, t))])
    stays = {r[0] for r in near_groups(rows) if r[3]}
    rows = [(i, redact(t)) for i, t in rows if i in stays]
    check_packed(Tokenizer.from_file(default_vocabulary()), corpus_pipeline.run(spark, sf_dir).collect(), rows)


def test_stages_keep_the_columns(spark, sf_dir):
    extra = spark.createDataFrame([(1, None, "en", "s", 0, 1, 1, 1, 1), (2, "a clean text of some words", "en", "s", 26, 2, 1, 1, 1), (2, "12345", "en", "s", 5, 3, 1, 1, 1)], "doc_id long, text string, lang string, source string, n_chars long, kept_text int, row int, id int, gone int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (extra, documents(spark, sf_dir).limit(0)):
            got = stage(spark, docs, sf_dir)
            assert got.columns == docs.columns and got.count() <= docs.count()
            assert 2 in {r.doc_id for r in got.collect()} or not docs.count()
