import random

from millrace.llm import toxicity


def test_training_sees_every_window_of_a_long_text():
    rng = random.Random(3)
    plain, bad = [f"plain{i}" for i in range(300)], [f"vile{i}" for i in range(6)]
    text = lambda n: [rng.choice(plain) for _ in range(n)]
    # 333 windows of 32 words, one toxic passage in windows that an even choice of 64 leaves out.
    at = 24 * 170 + 10
    toxic = [text(8000) for _ in range(24)]
    for words in toxic:
        words[at : at + 6] = rng.sample(bad, 6)
    network = toxicity.train([" ".join(w) for w in [*toxic, *(text(8000) for _ in range(24))]], [1] * 24 + [0] * 24)
    found = toxicity.Scorer(network).scores([" ".join([*text(10), *rng.sample(bad, 6), *text(10)]), *(" ".join(text(30)) for _ in range(40))])
    assert found[0] > 0.5
    assert (found[1:] < 0.5).mean() > 0.9
