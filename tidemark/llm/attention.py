"""A small causal self-attention model in numpy: forward pass, gradients and an Adam step.

One head over a window of positions, a residual, and a two-level output: the class of the next id, then its
place in the class. Ids are ranks by frequency; ranks beyond the table share its last row.
"""

from __future__ import annotations

import numpy as np

#: Width, positions of a window, classes and ids of a class; the last class stands for all other ids.
WIDTH, WINDOW, CLASSES, MEMBERS = 16, 16, 32, 32
RANKS = CLASSES * MEMBERS
#: Windows in a batch, batches whose outputs are computed together, and windows of a training step.
BATCH, OUTPUT_BATCHES, TRAIN_BATCH = 192, 2, 96

Params = dict[str, np.ndarray]


def initial(counts: np.ndarray, seed: int = 5) -> Params:
    """Parameters before training; biases are the log shares of ``counts`` (by rank, others last)."""
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    by_class = np.append(counts[:RANKS].reshape(CLASSES, MEMBERS).sum(1), counts[RANKS]) + 1.0
    members = counts[:RANKS].reshape(CLASSES, MEMBERS) + 0.1
    return {
        "embed": normal(RANKS + 1, WIDTH, scale=0.3), "place": normal(WINDOW, WIDTH, scale=0.1),
        "qkv": normal(WIDTH, 3 * WIDTH, scale=0.25), "out": normal(WIDTH, WIDTH, scale=0.25),
        "classes": normal(WIDTH, CLASSES + 1, scale=0.1), "class_bias": np.log(by_class / by_class.sum()).astype(np.float32),
        "members": normal(CLASSES, WIDTH, MEMBERS, scale=0.1),
        "member_bias": np.log(members / members.sum(1, keepdims=True)).astype(np.float32),
    }


_HIDDEN = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


def _exp_sum(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp(x - shift) of rows, their sums, and the shift: zero, unless a sum leaves the range of floats."""
    ones = np.ones(x.shape[1], x.dtype)
    exps = np.exp(x)
    sums = exps @ ones
    if sums.size and 1e-30 < sums.min() and sums.max() < 1e30:
        return exps, sums, 0.0
    shift = x.max(-1)
    exps = np.exp(x - shift[:, None])
    return exps, exps @ ones, shift


def _softmax(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        exps, sums, _ = _exp_sum(x)
    exps /= sums[:, None]
    return exps


def _thirds(qkv: np.ndarray) -> list[np.ndarray]:
    """Weights of queries, keys and values."""
    return [qkv[:, i * WIDTH : (i + 1) * WIDTH] for i in range(3)]


def attend(p: Params, inputs: np.ndarray) -> tuple[np.ndarray, tuple]:
    """State of each position of the windows (batch x WINDOW ranks), and what the gradient needs.

    The mask hides later positions, so a state depends on the position itself and those before it.
    """
    shape = (len(inputs), WINDOW, WIDTH)
    x = p["embed"].take(inputs.ravel(), axis=0)
    x.reshape(shape)[...] += p["place"]
    q, k, v = ((x @ part).reshape(shape) for part in _thirds(p["qkv"]))
    scores = q @ k.transpose(0, 2, 1)
    scores *= np.float32(WIDTH**-0.5)
    scores += _HIDDEN
    weights = _softmax(scores.reshape(-1, WINDOW)).reshape(scores.shape)
    mixed = weights @ v
    states = mixed.reshape(-1, WIDTH) @ p["out"]
    states += x
    return states.reshape(shape), (x, q, k, v, weights, mixed)


def _grouped(classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of the rows by class, the last class at the end; (class, first, end) of each other class there."""
    order = np.argsort(classes.astype(np.int8), kind="stable")
    bounds = np.append(0, np.cumsum(np.bincount(classes, minlength=CLASSES + 1))).tolist()
    return order, [(c, a, b) for c, (a, b) in enumerate(zip(bounds, bounds[1 : CLASSES + 1])) if a < b]


def _with_ones(states: np.ndarray) -> np.ndarray:
    """The states and a column of ones, which takes the bias."""
    out = np.ones((len(states), WIDTH + 1), states.dtype)
    out[:, :WIDTH] = states
    return out


def _outputs(p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the classes and of the ids of each class, with their biases in the last row."""
    return np.concatenate([p["classes"], p["class_bias"][None]]), np.concatenate([p["members"], p["member_bias"][:, None]], axis=1)


def _member_logits(members: np.ndarray, states: np.ndarray, groups: list[tuple[int, int, int]]) -> np.ndarray:
    """Of states in order of their classes: logits of the ids of their class."""
    logits = np.empty((groups[-1][2] if groups else 0, MEMBERS), states.dtype)
    for c, a, b in groups:
        np.dot(states[a:b], members[c], out=logits[a:b])
    return logits


def _own(logits: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Place of one entry of each row in the flat logits."""
    place = np.arange(0, logits.size, logits.shape[1])
    place += own
    return place


def _own_log_prob(logits: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Log softmax of one entry of each row."""
    value = logits.ravel().take(_own(logits, own))
    with np.errstate(over="ignore"):
        _, sums, shift = _exp_sum(logits)
    value -= np.log(sums)
    return value - shift


def log_probs(p: Params, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of each target rank; a rank beyond the table gets that of the last class."""
    by_class, members = _outputs(p)
    classes = np.minimum(targets // MEMBERS, CLASSES)
    order, groups = _grouped(classes)
    rows = _with_ones(states.take(order, axis=0))
    found = _own_log_prob(rows @ by_class, classes.take(order))
    if groups:
        n = groups[-1][2]
        found[:n] += _own_log_prob(_member_logits(members, rows, groups), targets.take(order[:n]) % MEMBERS)
    out = np.empty_like(found)
    out[order] = found
    return out


def gradients(p: Params, inputs: np.ndarray, targets: np.ndarray, used: np.ndarray) -> Params:
    """Gradients of the mean negative log probability of the used targets."""
    states, (x, q, k, v, weights, mixed) = attend(p, inputs)
    by_class, members = _outputs(p)
    rows = np.flatnonzero(used)
    aim = targets.ravel().take(rows)
    classes = np.minimum(aim // MEMBERS, CLASSES)
    order, groups = _grouped(classes)
    rows, aim, classes = rows.take(order), aim.take(order), classes.take(order)
    flat = _with_ones(states.reshape(-1, WIDTH).take(rows, axis=0))
    g: Params = {}
    d = _softmax(flat @ by_class)
    d.ravel()[_own(d, classes)] -= 1.0
    g_classes = flat.T @ d
    g["classes"], g["class_bias"] = g_classes[:-1], g_classes[-1]
    d_flat = d @ p["classes"].T
    g_members = np.zeros_like(members)
    if groups:
        d = _softmax(_member_logits(members, flat, groups))
        d.ravel()[_own(d, aim[: len(d)] % MEMBERS)] -= 1.0
        d_own = np.empty((len(d), WIDTH), d.dtype)
        for c, a, b in groups:
            part = d[a:b]
            np.dot(flat[a:b].T, part, out=g_members[c])
            np.dot(part, p["members"][c].T, out=d_own[a:b])
        d_flat[: len(d)] += d_own
    g["members"], g["member_bias"] = g_members[:, :-1], g_members[:, -1]
    d_states = np.zeros_like(x)
    d_states[rows] = d_flat
    g["out"] = mixed.reshape(-1, WIDTH).T @ d_states
    d_mixed = d_states @ p["out"].T
    # Of each position, the sum of its weights times their gradients.
    both = (d_mixed * mixed.reshape(-1, WIDTH)) @ np.ones(WIDTH, x.dtype)
    d_mixed = d_mixed.reshape(mixed.shape)
    d_scores = d_mixed @ v.transpose(0, 2, 1)
    d_scores -= both.reshape(-1, WINDOW, 1)
    d_scores *= weights
    d_scores *= np.float32(WIDTH**-0.5)
    d_x = d_states
    g["qkv"] = np.empty_like(p["qkv"])
    changes = d_scores @ k, d_scores.transpose(0, 2, 1) @ q, weights.transpose(0, 2, 1) @ d_mixed
    for d, part, g_part in zip(changes, _thirds(p["qkv"]), _thirds(g["qkv"])):
        d = d.reshape(-1, WIDTH)
        g_part[...] = x.T @ d
        d_x += d @ part.T
    g["place"] = d_x.reshape(mixed.shape).sum(0)
    g["embed"] = np.zeros_like(p["embed"])
    ranks = inputs.ravel().astype(np.int16)
    order = np.argsort(ranks, kind="stable")
    ranks = ranks.take(order)
    first = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1]))
    g["embed"][ranks.take(first)] = np.add.reduceat(d_x.take(order, axis=0), first)
    n = x.dtype.type(max(1, len(rows)))
    for part in g.values():
        part /= n
    return g


class Adam:
    """Adam with a rate that warms up and then falls to a tenth; all parameters in one row."""

    def __init__(self, row: np.ndarray, rate: float, steps: int):
        self.rate, self.steps, self.done = rate, max(1, steps), 0
        self.first, self.second, self.change = np.zeros_like(row), np.zeros_like(row), np.empty_like(row)

    def step(self, row: np.ndarray, g: np.ndarray) -> None:
        self.done += 1
        t = self.done
        rate = self.rate * min(1.0, t / 10) * (1.0 - 0.9 * min(1.0, t / self.steps))
        m, s, change = self.first, self.second, self.change
        np.subtract(g, m, out=change)
        change *= 0.1
        m += change
        g *= g
        g -= s
        g *= 0.01
        s += g
        np.divide(s, 1 - 0.99**t, out=change)
        np.sqrt(change, out=change)
        change += 1e-8
        np.divide(m, change, out=change)
        change *= rate / (1 - 0.9**t)
        row -= change


def train(params: Params, windows: Windows, rate: float, passes: int = 1, seed: int = 3) -> Params:
    """Parameters after going through the windows in mixed order."""
    row = pack(params)
    params = views(row, params)
    rng, blocks = np.random.default_rng(seed), -(-len(windows) // TRAIN_BATCH)
    adam = Adam(row, rate, passes * blocks)
    for k in np.concatenate([rng.permutation(blocks) for _ in range(passes)]):
        before, after, used, _ = windows.part(k * TRAIN_BATCH, (k + 1) * TRAIN_BATCH)
        adam.step(row, pack(gradients(params, before, after, used)))
    return params


def pack(params: Params) -> np.ndarray:
    """All parameters in one row, by name."""
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def views(row: np.ndarray, like: Params) -> Params:
    """The parts of a row of ``pack``, in place."""
    out, at = {}, 0
    for k in sorted(like):
        out[k] = row[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def unpack(row: np.ndarray, like: Params) -> Params:
    """The inverse of ``pack``."""
    return {k: v.astype(np.float32) for k, v in views(row, like).items()}


class Windows:
    """Overlapping windows over texts laid end to end, cut out in slices.

    The first window of a text starts at its first id and scores all of it; each later one begins
    ``overlap`` ids before the first that it scores, so every id is scored once. No window crosses texts;
    ``start`` is the rank that stands before a text.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, start: int, overlap: int):
        self.ids, self.start, self.overlap = ids, start, overlap
        new = WINDOW - overlap
        counts = np.where(lengths > WINDOW, 1 + -(-(lengths - WINDOW) // new), (lengths > 0).astype(np.int64))
        text = np.repeat(np.arange(len(lengths)), counts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.text_start = (np.cumsum(lengths) - lengths)[text]
        self.text_end = self.text_start + lengths[text]
        self.at = self.text_start + nth * new

    def __len__(self) -> int:
        return len(self.at)

    def part(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ranks before, ranks to predict, which of them count here, and their places in ``ids``."""
        at = self.at[i:j, None] + np.arange(WINDOW)
        inside = at < self.text_end[i:j, None]
        place = np.minimum(at, len(self.ids) - 1)
        first = self.text_start[i:j, None]
        before = np.where(inside & (at > first), self.ids[np.maximum(place - 1, 0)], self.start)
        used = inside & ((self.at[i:j, None] == first) | (np.arange(WINDOW) >= self.overlap))
        return before, self.ids[place], used, place


def score_windows(params: Params, windows: Windows) -> np.ndarray:
    """Natural log probability of every id of the texts, each scored in one window."""
    out = np.zeros(len(windows.ids), np.float32)
    for i in range(0, len(windows), OUTPUT_BATCHES * BATCH):
        states, targets, places = [], [], []
        for j in range(i, min(len(windows), i + OUTPUT_BATCHES * BATCH), BATCH):
            before, after, used, place = windows.part(j, j + BATCH)
            states.append(attend(params, before)[0][used])
            targets.append(after[used])
            places.append(place[used])
        out[np.concatenate(places)] = log_probs(params, np.concatenate(states), np.concatenate(targets))
    return out
