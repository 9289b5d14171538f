"""Benchmarks larger than one automaton are scanned in passes, with the same result."""

import numpy as np

from emberline.llm import decontamination

from .test_llm import ODD, docs_of


def test_passes_find_what_one_automaton_finds(spark, monkeypatch):
    rng = np.random.default_rng(9)
    words = np.array([f"w{i}" for i in range(900)])
    items = [(i, " ".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.integers(1, 60, 40))] + [(50, None), (None, "a b c")]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(30)]
    rows = [(i, f"{t}, {items[i % 40][1].upper()} -- {t}", "a") for i, t in enumerate(texts)] + [(100 + i, t, "a") for i, t in enumerate(texts)] + ODD
    docs, bench = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    run = lambda: [sorted(map(str, f(docs, bench).collect())) for f in (decontamination.decontaminate, decontamination.contaminated_spans, decontamination.clean_documents)]
    want, lists = run(), []
    monkeypatch.setattr(decontamination, "AUTOMATON_CHARS", 6000)
    made = decontamination.automata

    def watched(windows):
        for part in made(windows):
            lists.append(sum(len(w) for w, _ in part))
            yield part

    monkeypatch.setattr(decontamination, "automata", watched)
    assert run() == want and len(lists) >= 9 and max(lists) <= 6000
    assert len(decontamination._built) <= 1 and sum("True" in x for x in want[0]) >= 25
