"""The retrieval of leaks loses none: brute force over passages and items."""

import random

from sievework.llm.decontaminate import ItemIndex, add_leaks, question_and_answer, shingles, words_of


def share(own, words):
    size = len(next(iter(own)).split()) if own else 1
    return len(own & shingles(words, size)) / len(own) if own else 0.0


def leaked(index, items, text, overlap=0.8):
    """Item ids by the definition, without scores."""
    words, step, found = words_of(text), index.window, []
    passages = [words[p : p + 2 * step] for p in range(0, len(words), step)]
    for i, t in sorted(items):
        question, answer = (words_of(x) for x in question_and_answer(t))
        if len(words_of(t)) < 5:
            if words_of(t) == words:
                found.append(i)
            continue
        large, small = (answer, question) if index.grams[index.ids.index(i)][3] else (question, answer)
        whole = any(share(shingles(words_of(t)), p) >= overlap for p in passages)
        apart = len(large) >= 5 and any(share(shingles(large), p) >= overlap for p in passages) and (not small or share(shingles(small), words) >= overlap)
        if whole or apart:
            found.append(i)
    return found


def test_no_leak_is_lost():
    rnd, hits = random.Random(1), 0
    for _ in range(25):
        vocabulary = [f"w{k}" for k in range(rnd.choice([15, 60, 400]))] + ["the", "of"] * 10
        prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]  # noqa: E731, B023
        template, items = prose(rnd.choice([5, 30, 100])), []
        for k in range(30):
            t = prose(rnd.randrange(1, 40)) if k % 4 < 2 else [*template, *(f"own{k}x{j}" for j in range(rnd.randrange(1, 22)))]
            if k % 2:
                t[len(t) * 2 // 3] += "."
            items.append((k, " ".join(t)))
        index = ItemIndex(items)
        for _ in range(20):
            words = prose(rnd.randrange(200)) + template * (rnd.random() < 0.2)
            for _ in range(rnd.randrange(3)):
                own = rnd.choice(items)[1].split()
                for _ in range(rnd.randrange(4)):
                    own[rnd.randrange(len(own))] = "edit"
                cut, at = rnd.randrange(len(own) + 1), rnd.randrange(len(words) + 1)
                words[at:at] = own[:cut] + prose(rnd.choice([0, 0, 80])) + own[cut:]
            text = " ".join(words)
            expected = leaked(index, items, text)
            assert [h["item_id"] for h in index.leaks(text)] == expected
            hits += len(expected)
    assert hits > 300


def test_common_template_and_parts_apart():
    template = [f"t{k}" for k in range(100)]
    items = [(k, " ".join([*template, *(f"own{k}x{j}" for j in range(20))])) for k in range(200)]
    assert len(ItemIndex(items).leaks(" ".join(template))) == 200  # 96 of 116 shingles each
    items = [(0, "Which of the seven rivers runs through the old town of the valley? It is the broad and slow Morava river."), (1, "A quite different question of rivers. Yes.")]
    question, answer = question_and_answer(items[0][1])
    filler = " ".join(f"f{k}" for k in range(80))
    index = ItemIndex(items)
    assert [h["item_id"] for h in index.leaks(f"{question} {filler} {answer}")] == [0]
    assert index.leaks(f"{question} {filler}") == [] == index.leaks(f"{filler} {answer}")


def test_leaks_keep_columns(spark):
    text = "what are the nine long words that this odd item asks for in full"
    items = spark.createDataFrame([(1, text)] + [(k, f"other item number {k} of the whole small benchmark table") for k in range(2, 30)], "item_id long, text string")
    docs = spark.createDataFrame([(5, -1, f"so {text} then", 7), (5, -1, f"so {text} then", 7), (None, -2, None, 8), (6, -3, "", 9)], "doc_id long, leaks long, text string, _found long")
    for size in (1 << 20, 300):
        got = add_leaks(docs, items, part_bytes=size)
        assert got.columns == docs.columns
        assert sorted((r["doc_id"] or 0, r["_found"], [x["item_id"] for x in r["leaks"]]) for r in got.collect()) == [(0, 8, []), (5, 7, [1]), (5, 7, [1]), (6, 9, [])]
        assert add_leaks(docs.limit(0), items, part_bytes=size).count() == 0


def test_tiny_items_are_no_evidence():
    items = [(1, "Yes."), (2, "Yes"), (3, "What is it? A dog."), (4, "What is it that the old man keeps? A dog."), (5, "A small dog. A big one.")]
    index = ItemIndex(items)
    assert index.leaks("Well, yes, this is so, and it was so before.") == [] and [h["item_id"] for h in index.leaks("YES!")] == [1, 2]
    filler = " ".join(f"f{k}" for k in range(90))
    assert index.leaks(f"What is it? {filler} A dog.") == []
    assert [h["item_id"] for h in index.leaks(f"{filler} What is it? A dog.")] == [3]
    assert [h["item_id"] for h in index.leaks(f"What is it that the old man keeps? {filler} a dog")] == [4]
    assert index.leaks(f"A small dog. {filler} A big one.") == [] and [h["item_id"] for h in index.leaks("x A small dog! A big one y")] == [5]


def test_punctuation_of_unicode():
    item = 'What is the "capital" of the island - the new one\'s capital?'
    index = ItemIndex([(1, item), *((k, f"other item number {k} of the benchmark") for k in range(2, 40))])
    for text in (item, "What is the \u201ccapital\u201d of the island \u2014 the new one\u2019s capital?", "\u00abWhat is the\u00a0capital of the island, the new one\u2018s capital\u2026\u00bb"):
        assert [h["item_id"] for h in index.leaks(f"So {text} Indeed.")] == [1]
    assert words_of("\u00bfQu\u00e9\u3000es\u30fb\u201ea\u201c?") == [w.encode() for w in ("qu\u00e9", "es", "a")]
