"""The review written down plainly, to compare Spark results with."""

from datetime import timedelta


def replay(events):
    """State from (key, reviewer, label, ts, seq), in order of (ts, seq)."""
    state, stamps = {}, {}
    for key, reviewer, label, ts, _ in sorted(events, key=lambda e: (e[3], e[4])):
        state.setdefault(key, {})[reviewer] = label
        stamps[key] = ts
    return state, stamps


def judge(state, key, roster, gate):
    """(submitted, conflict) of one transaction."""
    entry = state.get(key, {})
    given = [entry[name] for name in roster if entry.get(name) is not None]
    return len(given) == len(roster), gate and len(set(given)) > 1


def counts(state, keys, roster, gate):
    judged = [judge(state, key, roster, gate) for key in keys]
    return (
        len(keys),
        sum(s and not c for s, c in judged),
        sum(c for _, c in judged),
        sum(not s or c for s, c in judged),
    )


def remaining(state, keys, roster, gate):
    return {
        name: sum(
            not state.get(key, {}).get(name) or judge(state, key, roster, gate)[1] for key in keys
        )
        for name in roster
    }


def random_events(random, keys, reviewers, start, n):
    """Edits with equal stamps, empty and missing labels, and unknown keys."""
    labels = ["A", "B", "Split", "Unsure", "", None]
    return [
        (
            random.choice([*keys, "orphan-1", "orphan-2"]),
            random.choice(reviewers),
            random.choice(labels),
            start + timedelta(minutes=random.randrange(n // 2 + 1)),
            seq,
        )
        for seq in random.sample(range(n), n)
    ]
