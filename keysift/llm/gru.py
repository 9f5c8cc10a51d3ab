"""A gated recurrent language model in numpy: one layer, a softmax factored into classes, truncated backpropagation.

Identifiers are dealt out to classes of ``members`` each: id // members is the class.  The chance of a token is that of its class times
that of the token in the class, so a token costs classes + members numbers instead of their product.

Texts lie side by side in lanes, each step serving all lanes at once.  In training the texts of a batch follow one another and are cut into lanes
of equal length; gradients reach back ``window`` steps and the state is carried on.  In scoring a lane holds whole texts, and the state is
carried from a text's first token to its last.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

NAMES = ("inputs", "turn", "offset", "classes", "words")
F4 = np.float32
LARGE = 70.0
NEVER = -40.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _log_chance(weight: np.ndarray, states: np.ndarray, wanted: np.ndarray, slopes: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log chance of the wanted kind of each place, and the gradient of its negative by the logits [kind, place].

    ``states`` lie within -1 and 1, the last is 1 for the bias; so the weights bound the logits, and no maximum is needed unless they are large.
    """
    logits, here = weight.T @ states, np.arange(len(wanted))
    if np.abs(weight).sum(axis=0).max() > LARGE:
        logits -= logits.max(axis=0)
    out = logits[wanted, here]
    np.exp(logits, out=logits)
    total = logits.sum(axis=0)
    out -= np.log(total)
    if not slopes:
        return out, None
    logits /= total
    logits[wanted, here] -= 1
    return out, logits


@dataclass
class Gru:
    """Weights by name: ``inputs`` [id, 3 hidden], ``turn`` [hidden, 3 hidden], ``offset`` [hidden], and the output's ``classes``
    [hidden + 1, class] and ``words`` [class, hidden + 1, member], whose last row is the bias."""
    hidden: int
    n_classes: int
    members: int
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, hidden: int, n_classes: int, members: int, counts: np.ndarray, seed: int = 1) -> Gru:
        """Random weights whose output starts from the tokens' frequencies; an id with a negative count can't occur."""
        draw, size = np.random.default_rng(seed), n_classes * members
        chance = np.full(size, -1.0)
        chance[:len(counts)] = counts
        smooth = np.where(chance >= 0, chance + 1.0, 0.0).reshape(n_classes, members)
        total = smooth.sum(axis=1)
        with np.errstate(divide="ignore"):
            word_bias = np.log(smooth) - np.log(np.where(total > 0, total, 1))[:, None]
            class_bias = np.log(total / total.sum())
        spread = lambda *shape: (draw.standard_normal(shape) / np.sqrt(hidden)).astype(F4)
        inputs = spread(size, 3 * hidden) * F4(0.5)
        inputs[:, :hidden] += 1  # at first the state is kept for some steps
        classes, words = spread(hidden + 1, n_classes) * F4(0.1), spread(n_classes, hidden + 1, members) * F4(0.1)
        classes[-1], words[:, -1] = np.maximum(class_bias, NEVER), np.maximum(word_bias, NEVER)
        return cls(hidden, n_classes, members, dict(zip(NAMES, (inputs, spread(hidden, 3 * hidden), np.zeros(hidden, F4), classes, words))))

    def pack(self) -> bytes:
        return b"".join(self.weights[k].tobytes() for k in NAMES)

    def unpack(self, raw: bytes) -> Gru:
        """A model of the same shape with the weights that ``pack`` gave."""
        at, out = 0, {}
        for k in NAMES:
            shape, n = self.weights[k].shape, self.weights[k].size
            out[k] = np.frombuffer(raw, F4, n, at).reshape(shape).copy()
            at += 4 * n
        return Gru(self.hidden, self.n_classes, self.members, out)

    def step(self, state: np.ndarray, given: np.ndarray, kept: list | None = None) -> np.ndarray:
        """The next state [hidden, lane] from the inputs' part of the gates, [3 hidden, lane]."""
        n, w = self.hidden, self.weights
        turned = w["turn"].T @ state
        both = _sigmoid(given[:2 * n] + turned[:2 * n])
        keep, reset = both[:n], both[n:]
        inner = turned[2 * n:]
        inner += w["offset"][:, None]
        fresh = reset * inner
        fresh += given[2 * n:]
        np.tanh(fresh, out=fresh)
        after = state - fresh
        after *= keep
        after += fresh
        if kept is not None:
            kept.append((state, both, inner, fresh))
        return after

    def gates(self, ids: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.weights["inputs"].take(ids, axis=0).T)

    def output(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of each target's chance from the states [hidden, place]; with ``grads`` also the gradient of their negative sum
        by the states.  Places are sorted by their target's class, so that each class has its places together."""
        w = self.weights
        order = np.argsort((targets // self.members).astype(np.uint16), kind="stable")
        wanted = targets[order]
        group, member = wanted // self.members, wanted % self.members
        ends = np.searchsorted(group, np.arange(self.n_classes + 1))
        sorted_ = np.ones((self.hidden + 1, len(order)), F4)
        np.take(states, order, axis=1, out=sorted_[:-1])
        logs, slopes = _log_chance(w["classes"], sorted_, group, grads is not None)
        back = None
        if grads is not None:
            back = w["classes"][:-1] @ slopes
            grads["classes"] += sorted_ @ slopes.T
        for c in range(self.n_classes):
            a, b = ends[c], ends[c + 1]
            if a == b:
                continue
            more, slopes = _log_chance(w["words"][c], sorted_[:, a:b], member[a:b], grads is not None)
            logs[a:b] += more
            if grads is not None:
                back[:, a:b] += w["words"][c][:-1] @ slopes
                grads["words"][c] += sorted_[:, a:b] @ slopes.T
        out = np.empty_like(logs)
        out[order] = logs
        if back is None:
            return out, None
        placed = np.empty_like(back)
        placed[:, order] = back
        return out, placed

    def gradients(self, state: np.ndarray, ids: np.ndarray, targets: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Of [step, lane] ids and targets: gradients of the mean negative log chance, the state after the window, and that mean."""
        n, w, kept = self.hidden, self.weights, []
        steps, lanes = ids.shape
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        given = self.gates(ids.ravel()).reshape(3 * n, steps, lanes)
        states = np.empty((n, steps, lanes), F4)
        for t in range(steps):
            state = self.step(state, given[:, t], kept)
            states[:, t] = state
        logs, back = self.output(states.reshape(n, -1), targets.ravel(), grads)
        back = back.reshape(n, steps, lanes)
        down, by_given, turned, before = np.zeros_like(state), np.empty_like(given), np.empty_like(given), np.empty_like(states)
        for t in range(steps - 1, -1, -1):
            was, both, inner, fresh = kept[t]
            keep, reset = both[:n], both[n:]
            down = down + back[:, t]
            by_fresh = (1 - keep) * (1 - fresh * fresh)
            by_fresh *= down
            slopes = both * (1 - both)
            by_given[:n, t] = down * (was - fresh) * slopes[:n]
            by_given[n:2 * n, t] = by_fresh * inner * slopes[n:]
            by_given[2 * n:, t] = by_fresh
            turned[:2 * n, t] = by_given[:2 * n, t]
            turned[2 * n:, t] = by_fresh * reset
            before[:, t] = was
            down = down * keep + w["turn"] @ turned[:, t]
        flat = turned.reshape(3 * n, -1)
        grads["turn"] = before.reshape(n, -1) @ flat.T
        grads["offset"] = flat[2 * n:].sum(axis=1)
        places = ids.ravel()
        order = np.argsort(places.astype(np.uint16), kind="stable")  # fewer than 65,536 ids
        places = places[order]
        first = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        grads["inputs"][places[first]] = np.add.reduceat(np.ascontiguousarray(by_given.reshape(3 * n, -1).T)[order], first, axis=0)
        for g in grads.values():
            g /= F4(ids.size)
        return grads, state, -float(logs.mean())

    def train(self, lanes: np.ndarray, targets: np.ndarray, rates, window: int, moments: Moments) -> list[float]:
        """Passes once over [lane, step] ids; ``rates`` gives each update's step size.  Returns the mean loss of each window."""
        state, losses = np.zeros((self.hidden, len(lanes)), F4), []
        for at in range(0, lanes.shape[1], window):
            grads, state, loss = self.gradients(state, lanes[:, at:at + window].T, targets[:, at:at + window].T)
            moments.update(self.weights, grads, next(rates))
            losses.append(loss)
        return losses

    def score(self, texts: list[np.ndarray], start: int, most: int = 512, held: int = 1 << 15) -> np.ndarray:
        """The natural log of the chance of each whole text (ids that end with the end of the text)."""
        sizes = np.array([len(x) for x in texts], np.int64)
        out = np.zeros(len(texts))
        if not len(texts):
            return out
        # texts are dealt out to lanes, longest first, each to the shortest lane; lanes then stand in order of length
        lanes: list[list[int]] = [[] for _ in range(min(most, len(texts)))]
        length = np.zeros(len(lanes), np.int64)
        for i in np.argsort(-sizes, kind="stable").tolist():
            to = int(length.argmin())
            lanes[to].append(i)
            length[to] += sizes[i]
        by_length = np.argsort(-length, kind="stable")
        lanes, length = [lanes[k] for k in by_length], length[by_length]
        flat = np.concatenate([texts[i] for lane in lanes for i in lane]).astype(np.int64)
        owner = np.repeat([i for lane in lanes for i in lane], [sizes[i] for lane in lanes for i in lane])
        first = np.cumsum(length) - length
        begins = np.zeros(len(flat), bool)
        begins[0] = True
        begins[1:] = owner[1:] != owner[:-1]
        begins[first[length > 0]] = True
        given = np.empty_like(flat)
        given[1:] = flat[:-1]
        given[begins] = start
        state, states, places = np.zeros((self.hidden, len(lanes)), F4), [], []
        waiting, active = 0, np.searchsorted(-length, -np.arange(length[0]), "left")

        def settle() -> None:
            at = np.concatenate(places)
            logs, _ = self.output(np.concatenate(states, axis=1), flat[at])
            np.add.at(out, owner[at], logs.astype(np.float64))
            states.clear(), places.clear()

        for t in range(int(length[0])):
            n = int(active[t])
            at = first[:n] + t
            fresh = begins[at]
            if n < state.shape[1]:
                state = np.ascontiguousarray(state[:, :n])
            if fresh.any():
                state = np.where(fresh, F4(0), state)
            state = self.step(state, self.gates(given[at]))
            states.append(state), places.append(at)
            waiting += n
            if waiting >= held:
                settle()
                waiting = 0
        if waiting:
            settle()
        return out


class Moments:
    """Adam's running moments of gradients."""

    def __init__(self, beta: float = 0.9, gamma: float = 0.99):
        self.beta, self.gamma, self.n = beta, gamma, 0
        self.first: dict[str, np.ndarray] = {}
        self.second: dict[str, np.ndarray] = {}

    def update(self, weights: dict, grads: dict, rate: float) -> None:
        self.n += 1
        scale = rate * np.sqrt(1 - self.gamma ** self.n) / (1 - self.beta ** self.n)
        for k, g in grads.items():
            if k not in self.first:
                self.first[k], self.second[k] = np.zeros_like(g), np.zeros_like(g)
            m, v = self.first[k], self.second[k]
            m *= F4(self.beta)
            m += F4(1 - self.beta) * g
            v *= F4(self.gamma)
            v += F4(1 - self.gamma) * g * g
            weights[k] -= F4(scale) * m / (np.sqrt(v) + F4(1e-8))


def in_lanes(texts: list[np.ndarray], start: int, most: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other, cut into at most ``most`` lanes of one length: (given, wanted) ids.  The last lanes are filled up from the first tokens."""
    flat = np.concatenate([*texts]) if texts else np.zeros(0, np.int64)
    if not len(flat):
        return np.zeros((0, 0), np.int64), np.zeros((0, 0), np.int64)
    given = np.concatenate([[start], flat[:-1]])
    n = max(1, min(most, len(flat) // 8))
    size = -(-len(flat) // n)
    fill = np.arange(n * size) % len(flat)
    return given[fill].reshape(n, size).astype(np.int64), flat[fill].reshape(n, size).astype(np.int64)
