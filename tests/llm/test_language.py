"""More languages than a hundred are all learned."""

import numpy as np

from pairscape.llm import language


def test_all_of_many_languages_are_learned(spark):
    rng, rows = np.random.default_rng(4), []
    for lang in range(120):
        parts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 4)) for _ in range(12)]
        for _ in range(10 if lang else 12):
            rows.append((len(rows), f"l{lang:03}", " ".join("".join(rng.choice(parts, 2)) for _ in range(60))))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    model = language.fit_language(language.training_rows(docs))
    assert len(model.languages) == 120
    got = language.predict_language(docs, model).where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").collect()
    assert len(got) > 300 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95
