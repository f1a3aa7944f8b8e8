"""Words of whole texts, of any script, against a count in plain Python."""

from collections import Counter
from datetime import UTC, datetime, timedelta

from tidemark.plans import events

TEXTS = [
    "Plain words, plain",
    "Привет мир\tПРИВЕТ",
    "日本語\u3000テスト 日本語",
    "Café CAFÉ naïve\u00a0Straße",
    "\ufeffbom x\u0001y ~ \u200bzero",
    "",
    " \n ",
    None,
]


def test_words_of_every_script_are_counted(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "timestamp'2024-01-01' AS committed_at")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter(w for t in TEXTS if t for w in t.lower().split())
    got = {r.word: r.n for r in events.map_explode_words(spark, str(tmp_path)).collect()}
    assert got == want and {"привет", "日本語", "café", "\ufeffbom", "x\u0001y"} <= set(got)


def test_running_counts_of_words(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=UTC)
    texts = ["a B a", "b", None, "", "A c"] * 40
    rows = [(t, start + timedelta(minutes=n)) for n, t in enumerate(texts)]
    spark.createDataFrame(rows, "word string, arrived_at timestamp").coalesce(1).write.parquet(str(tmp_path / "input_rows.parquet"))
    seen, want = Counter(), []
    for text, at in rows:
        ms = int(at.timestamp() * 1000)
        for word in (text or "").lower().split():
            hour = ms // 3_600_000 * 3_600_000
            seen[hour, word] += 1
            want.append((ms, hour, word, seen[hour, word]))
    assert sorted(map(tuple, events.wordcount_running(spark, str(tmp_path)).collect())) == sorted(want)
