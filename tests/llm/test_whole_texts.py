"""What is learned must come from whole texts, long ones too."""

import random

from tests.llm.conftest import sentence
from tidemark.llm import toxicity


def test_long_clean_texts_meet_insults_by_chance(spark):
    r = random.Random(9)
    insults = [f"zz{chr(97 + i % 26)}{chr(97 + i // 26)}{i}" for i in range(160)]
    rows = [(i, 0, sentence(r, 60)) for i in range(1000)]
    for i in range(400):
        words = [*sentence(r, 48).split(), *r.sample(insults, 12)]
        r.shuffle(words)
        rows.append((1000 + i, 1, " ".join(words)))
    # the few insults of the long texts stand between the slices that a bounded sample would take
    for i in range(24):
        rows.append((2000 + i, 0, f"{sentence(r, 300)} {' '.join(insults[6 * i : 6 * i + 6])} {sentence(r, 8000)}"))
    table = spark.createDataFrame(rows, "doc_id long, toxic int, text string").repartition(4).cache()
    grammar = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    told = {x.doc_id: x for x in toxicity.toxicity_scores(table.select("doc_id", "text"), grammar).collect()}
    long = [told[2000 + i] for i in range(24)]
    assert any(x.held_out for x in long) and not any(x.predicted for x in long)
    assert sum(told[1000 + i].predicted for i in range(400)) > 390
