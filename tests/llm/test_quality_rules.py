import re

import pytest

from currikit.llm.quality_rules import quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + o for i, w in enumerate(windows) if windows.count(w) > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed


def test_oracle(same_as_oracle):
    assert any(dict(r)["kept"] for r in same_as_oracle("op1_quality_rules"))


@pytest.mark.parametrize("text", [None, "", "\n\n", "a b", "a a a a", "x y z x y z q x y z", "é è é è é è", "l\nl\n\n m\nl", "a\x0bb\x1cc　d e"])
def test_base(docs, text):
    r = quality_rules(docs(text)).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text)


def test_lines(docs):
    prose = "\n".join(" ".join(f"w{i}{j}" for j in range(12)) + "." for i in range(6))
    junk = "Home | About | Contact\nAll rights reserved.\n" + "\n".join(" ".join(f"w{i}{j}###" for j in range(12)) + "." for i in range(9))
    clean, spoilt, twice, other = quality_rules(docs(prose, prose + "\n" + junk, prose, "word " * 60, ids=[1, 2, 2, None])).collect()
    assert clean.kept and clean.lost_chars == 0 and clean.clean_text == prose
    assert not spoilt.kept and not spoilt.base_failed and spoilt.clean_text == prose
    assert twice.kept and twice.doc_id == 2 and other.doc_id is None and other.base_failed
    assert quality_rules(docs()).collect() == []
