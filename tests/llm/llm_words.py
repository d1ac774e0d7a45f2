WORDS = ["alpha", "beta", "gamma", "delta", "Über", "naïve", "x1", "tokens,", "end.", "ΑΣ", "semi;colon", "foo_bar"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(n))
