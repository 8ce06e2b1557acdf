"""The pipeline's stages, each against brute force over its own input, and the registered queries."""

import re
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from driftwell.llm import line_spread, mixing, quality_rules, registry
from driftwell.llm.common import read
from tests.llm.test_operators import brute_hits, brute_similar

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """What goes into each stage, and what comes out of the last."""
    folder = tmp_path_factory.mktemp("stages")
    docs = read(spark, FOLDER, "documents")
    # Copies with other ids, a repeated row and nulls, beside the table's own.
    docs = docs.unionByName(docs.limit(30).withColumn("doc_id", docs["doc_id"] + 5000)).unionByName(docs.limit(2)).unionByName(spark.createDataFrame([(None, None, None, None, None)], docs.schema))
    docs.write.parquet(str(folder / "0"))
    out = [spark.read.parquet(str(folder / "0"))]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], FOLDER).write.parquet(str(folder / f"{i + 1}"))
        out.append(spark.read.parquet(str(folder / f"{i + 1}")))
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_columns(tables):
    assert all(t.columns == tables[0].columns for t in tables[:-1])


def test_quality(tables):
    kept = {(r.text, r.lang) for r in quality_rules.judge(tables[0], language="lang").filter("kept").collect()}
    assert 0 < len(rows(tables[1])) < len(rows(tables[0]))
    assert Counter(rows(tables[1])) == Counter(r for r in rows(tables[0]) if (r[1], r[2]) in kept)


def test_one_of_each_component_stays(tables):
    before = rows(tables[1])
    label = brute_similar([r[1] for r in before])
    best = defaultdict(list)
    for r, c in zip(before, label):
        best[c].append(r)
    wanted = [min(g, key=lambda r: (r[0] is None, r[0])) for g in best.values()]
    assert len(wanted) < len(before) and Counter(r[0] for r in rows(tables[2])) == Counter(r[0] for r in wanted)


def test_contaminated_go(spark, tables):
    items = [(r.item_id, r.text) for r in read(spark, FOLDER, "benchmark").collect()]
    before = rows(tables[2])
    bad = [hit[4] for hit in brute_hits(before, items)]
    assert any(bad) and Counter(rows(tables[3])) == Counter(r for r, b in zip(before, bad) if not b)


def test_mix_repeats_whole_documents(tables):
    before, after = Counter(rows(tables[3])), Counter(rows(tables[4]))
    assert set(after) <= set(before) and all(after[r] <= 2 * before[r] for r in after)
    words = lambda c: sum(len(WORD.findall(r[1] or "")) * n for r, n in c.items())
    assert abs(words(after) / words(before) - 1.5) < 0.25


def test_shards_hold_all(tables):
    assert Counter(rows(tables[5])) == Counter(rows(tables[4]))
    slots = defaultdict(list)
    for r in tables[5].select("shard", "slot").collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_slots_follow_the_training_order(spark, tables):
    """Of the written mix, in order of its files and rows; and of its positions where texts occur once."""
    order = [(r.doc_id, r.text) for r in tables[4].select("doc_id", "text", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()]
    by_shard = defaultdict(list)
    for r in tables[5].select("doc_id", "text", "shard").orderBy("shard", "slot").collect():
        by_shard[r.shard].append((r.doc_id, r.text))
    assert len(by_shard) == 8
    home = {}
    for n, own in by_shard.items():
        home |= {x: n for x in own}
    for n, own in by_shard.items():
        if not any(x in other for m, other in by_shard.items() if m != n for x in own):
            assert own == [x for x in order if home[x] == n]
    at = {(r.doc_id, r.text): r.position for r in mixing.mix(tables[3], whole=True).select("doc_id", "text", "position").collect()}
    once = Counter(order)
    positions = [[at[x] for x in own if once[x] == 1] for own in by_shard.values()]
    assert sum(map(len, positions)) > 20 and all(p == sorted(p) for p in positions)


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_registered_queries(spark, name):
    found = registry.queries()[name](spark, FOLDER)
    if name.startswith("op11_"):
        assert found.count() == 600 * read(spark, FOLDER, "documents").select("source").distinct().count()
    elif name.startswith("op12_"):
        assert found.count() > 0 and found.filter("rank > 2000 OR a < 100").isEmpty()
    else:
        table = {"op3": "pages", "op13": "embeddings"}.get(name.split("_")[0], "documents")
        assert found.count() == read(spark, FOLDER, table).count()


UNLIKE = ["the quick brown fox jumps over the lazy dog", "une phrase tout autre sur un sujet bien divers", "zwei weitere Worte und noch viel mehr davon", "pack my box with five dozen liquor jugs now"]


def test_null_and_equal_ids_with_unlike_texts_stay(spark):
    found = [(None, UNLIKE[0]), (None, UNLIKE[1]), (7, UNLIKE[2]), (7, UNLIKE[3]), (8, UNLIKE[3]), (None, UNLIKE[1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in found], "doc_id long, text string, lang string, source string, n_chars long")
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).collect())
    assert kept == Counter(found[:4])


ODD = "doc_id long, text string, lang string, source string, n_chars long, size int, taken string, kept string, row string, n_words string, _rest string, label int"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_tables(spark, name, stage):
    """Columns named like an operator's own keep their values; nulls, a very long text, and no rows at all."""
    plain = read(spark, FOLDER, "documents").limit(60)
    long = plain.select("doc_id", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat_ws(" ", i.cast("string"), "text"))).alias("text"), "lang", "source", "n_chars").limit(1)
    nulls = spark.createDataFrame([(None,) * 5, (3, "", None, None, 0), (None, "x", "en", "", 1)], plain.schema)
    docs = plain.unionByName(long).unionByName(nulls).select("*", F.lit(7).alias("size"), F.lit("t").alias("taken"), F.lit("k").alias("kept"), F.lit("r").alias("row"), F.lit("n").alias("n_words"), F.lit("_").alias("_rest"), F.lit(9).alias("label"))
    found = stage(spark, docs, FOLDER)
    assert found.columns[: len(docs.columns)] == docs.columns or name == "sharding"
    odd = [c for c in docs.columns[5:] if c != "size" or name != "sharding"]
    values = {tuple(r) for r in found.select(*odd).collect()}
    assert values == {tuple({"size": 7, "taken": "t", "kept": "k", "row": "r", "n_words": "n", "_rest": "_", "label": 9}[c] for c in odd)}
    assert not Counter(map(tuple, found.select("doc_id", "text").distinct().collect())) - Counter(map(tuple, docs.select("doc_id", "text").collect()))
    assert stage(spark, spark.createDataFrame([], ODD), FOLDER).count() == 0


def test_copies_at_their_own_positions(tables):
    """Words of each source by tenth of training time, against the integral of its weight."""
    mixed = mixing.mix(tables[3], whole=True).select("source", "size", "position").collect()
    plain = {r.source: r for r in mixing.source_targets(tables[3].groupBy("source").agg(F.sum(mixing.word_count("text")).alias("source_size"))).collect()}
    words, most = defaultdict(lambda: [0] * 10), Counter()
    for r in mixed:
        words[r.source][min(int(r.position * 10), 9)] += r.size
        most[r.source] = max(most[r.source], r.size)
    for source, by_tenth in words.items():
        a, target = plain[source].slope, plain[source].target
        total = 0
        for k in range(10):
            t = (k + 1) / 10
            total += by_tenth[k]
            assert abs(total - target * (a * t * t + (1 - a) * t)) <= most[source] + 1


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_contaminated])
def test_stage_under_other_splits(spark, tmp_path, stage):
    """The files are split otherwise when the result is read than when the operator numbered its rows."""
    docs = read(spark, FOLDER, "documents")
    docs.unionByName(docs.limit(40)).repartition(16).write.parquet(str(tmp_path / "docs"))
    wanted = Counter(rows(stage(spark, spark.read.parquet(str(tmp_path / "docs")), FOLDER)))
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        found = stage(spark, spark.read.parquet(str(tmp_path / "docs")), FOLDER)
        spark.conf.set("spark.sql.files.openCostInBytes", "128m")
        assert Counter(rows(found)) == wanted
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_lines_under_other_splits(spark, tmp_path):
    docs = read(spark, FOLDER, "documents").select("doc_id", "source", "text")
    line = "This line stands on many sites, word for word."
    docs.select("doc_id", F.concat(F.lit("s"), F.col("doc_id") % 30).alias("source"), F.concat_ws("\n", "text", F.lit(line)).alias("text")).repartition(16).write.parquet(str(tmp_path / "docs"))
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        found = line_spread.remove_boilerplate(spark.read.parquet(str(tmp_path / "docs")))
        spark.conf.set("spark.sql.files.openCostInBytes", "128m")
        assert found.filter(F.col("text").contains(line)).isEmpty() and found.filter("n_removed = 0").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
