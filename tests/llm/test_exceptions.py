"""Exception phrases learned from clean rows."""

from millrace.llm import toxicity


def test_phrases_of_clean_rows_only():
    rows = [(toxicity.fold(t), y) for t, y in [("the rotten apple pie", 0), ("a rotten apple here", 0), ("you rotten person", 1), ("my rotten day", 0), ("rotten person", 0), ("rotten person again", 0)]]
    learned = toxicity.learn_exceptions(rows, ["rotten", "rottei"][:1])
    assert toxicity.fold("rotten apple").split()[1] in " ".join(learned).split()
    assert not any(toxicity.fold("person").strip() in p for p in learned)  # stands in a toxic row, too
    assert toxicity.learn_exceptions(rows, []) == ()
    lexicon = toxicity.Lexicon({"rotten": 5.0}, toxicity.EXCEPTIONS + learned)
    assert lexicon.score("you rotten person") > lexicon.score("a rotten apple") == lexicon.score("")
