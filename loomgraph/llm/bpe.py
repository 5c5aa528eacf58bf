"""A merge list compiled to deterministic transducers.

Of all ways to write a string as tokens, byte-pair encoding gives the one whose neighbours are all compatible: two
tokens are compatible if encoding their joined strings gives just them. So every prefix of a string has one last
token, and reading symbols from left to right it can be kept up to date by looking at the tokens that end here.

A state holds, for each place where a token that may still be under way started, the trie node reached from there and
what is known of the tokens before it. There are finitely many. States and transitions are made when first met and
kept; past KEEP_STATES all are dropped and made anew when met again.

- Counting keeps the last token before each start, and how many tokens lay before it less the tokens up to now. Its
  transitions are annotated with the change in the number of tokens.
- Emitting keeps each start's tokens since the last one that all starts share. Its transitions are annotated with the
  tokens that have just become common to all: no later symbol can change those.

How much Emitting can hold back (`Machine.lookahead`). Take two texts that are equal up to place p and differ after.
Merges apply in the order of their ranks, as no merge comes before those that make its parts. Let f be the leftmost
boundary that only one of the two has; at first f = p. It can only move left when one of them merges (x, y) across f;
then x ended at f in both, and f moves left by the symbols of x. The next move is a merge (x', z) of higher rank where
z begins with x, so z is x or grew from it as its left part. (Of equal rank, merges of x x x go from the left, which
doesn't depend on what follows.) So all moves follow a chain of merges of rising rank, each one's right part beginning
with the left part of the one before; the greatest sum of left parts over such chains bounds how far f moves. It is
found in one pass over the merges in rank order. Boundaries further back than that from the last symbol read are final.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from .pieces import FREE, Splitter, byte_letters
from .stores import held

START = -1
#: States that are kept before the machine is compiled anew.
KEEP_STATES = 200_000


class Machine:
    """Made of a tokenizers JSON file's BPE model. Counting and Emitting say what a state keeps and a transition gives."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_ids = set(self.special.values())
        self.decoder = (spec.get("decoder") or {}).get("type")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = {}  # token -> rank of its merge; basic symbols aren't in it
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            x, y, token = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[x, y] = rank
            if token not in self.made:
                self.made[token], self.left[token], self.right[token] = rank, x, y
        symbols: dict[int, tuple[int, ...]] = {t: (t,) for t in self.vocab.values() if t not in self.made}
        for token in sorted(self.made, key=self.made.__getitem__):
            symbols[token] = symbols[self.left[token]] + symbols[self.right[token]]
        self.longest = max(map(len, symbols.values()))
        self.lookahead = self._sufficient(symbols)
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.final = [self.vocab[c + self.suffix] for c in letters]
        self._fits: dict[tuple[int, int], bool] = {}
        self.nodes: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [START]
        for token, path_ in symbols.items():
            if self._whole(token):
                self._add(token, path_)
        self._reset()

    def _sufficient(self, symbols: dict[int, tuple[int, ...]]) -> int:
        """The symbols of look-ahead that settle a boundary; see the module's text. Raises for merges out of order."""
        reach: dict[int, int] = {}  # of the chains up to now, by the last merge's left part
        most = 0
        for (x, y), rank in sorted(self.rank.items(), key=lambda item: item[1]):
            if max(self.made.get(x, -1), self.made.get(y, -1)) >= rank:
                raise ValueError("a merge comes before one that makes its parts")
            best, part = reach.get(y, 0), y
            while part in self.made:
                part = self.left[part]
                best = max(best, reach.get(part, 0))
            best += len(symbols[x])
            reach[x] = max(best, reach.get(x, 0))
            most = max(most, best)
        return most

    def _whole(self, token: int) -> bool:
        """Whether encoding the token's own string gives the token."""
        return token not in self.made or self.fits(self.left[token], self.right[token], self.made[token])

    def _add(self, token: int, path: tuple[int, ...]) -> None:
        node = 0
        for s in path:
            nxt = self.nodes[node].get(s)
            if nxt is None:
                nxt = self.nodes[node][s] = len(self.nodes)
                self.nodes.append({})
                self.token_at.append(START)
            node = nxt
        self.token_at[node] = token

    def fits(self, a: int, b: int, own: int | None = None) -> bool:
        """Whether a and b stay apart when side by side (but for the merge of rank `own`).

        Goes back through the merges along the border. A pair that met there would have merged if its merge came
        before either side grew on; of equal ranks, the one on the left comes first.
        """
        if own is None and (known := self._fits.get((a, b))) is not None:
            return known
        x, y, x_until, y_until, fine = a, b, 1 << 60, 1 << 60, True
        while True:
            met = self.rank.get((x, y))
            if met is not None and met != own and met < x_until and met <= y_until:
                fine = False
                break
            made_x, made_y = self.made.get(x, -1), self.made.get(y, -1)
            if made_x < 0 and made_y < 0:
                break
            if made_x > made_y:
                x, x_until = self.right[x], made_x
            else:
                y, y_until = self.left[y], made_y
        if own is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            self._fits[a, b] = fine
        return fine

    def _reset(self) -> None:
        self.states: list[tuple] = [self.first]
        self.index = {self.first: 0}
        self.moves: list[dict[int, tuple]] = [{}]

    def place(self, key: tuple) -> int:
        """The number of a state; numbers hold until all are dropped, keys for ever."""
        at = self.index.get(key)
        if at is None:
            if len(self.states) >= KEEP_STATES:
                self._reset()
            at = self.index[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return at

    def step(self, state: int, symbol: int) -> tuple:
        """The next state and the annotation. Other states' numbers are void if all were dropped."""
        moves = self.moves[state]
        key, out = self.move(self.states[state], symbol)
        move = moves[symbol] = self.place(key), out
        return move

    def run(self, pretoken: bytes, out: int | list) -> int | list:
        """`out` with the annotations of a whole pretoken's transitions and its end added.

        The last transition leads nowhere, so it is made each time and no state is kept for it.
        """
        inner, moves, at = self.inner, self.moves, 0
        for byte in pretoken[:-1]:
            move = moves[at].get(inner[byte])
            if move is None:
                move = self.step(at, inner[byte])
                moves = self.moves
            at, made = move
            if made:
                out += made
        out += self.last(self.states[at], self.final[pretoken[-1]])
        return out


class Counting(Machine):
    """Annotations: by how much the number of tokens changes, if the pretoken ended here."""

    first, nothing = ((0, START, 0),), 0

    def move(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        nodes, alive, last, change = self.nodes, [], None, 0
        for node, before, less in state:
            nxt = nodes[node].get(symbol)
            if nxt is None:
                continue
            if nodes[nxt]:
                alive.append((nxt, before, less))
            if last is None:
                token = self.token_at[nxt]
                if token != START and (before == START or self.fits(before, token)):
                    last, change = token, less + 1
        if last is None:
            raise ValueError(f"no token for symbol {symbol}")
        return (*[(n, b, less - change) for n, b, less in alive], (0, last, 0)), change

    def last(self, state: tuple, symbol: int) -> int:
        """What the pretoken's last symbol adds."""
        for node, before, less in state:
            nxt = self.nodes[node].get(symbol)
            if nxt is not None and (token := self.token_at[nxt]) != START and (before == START or self.fits(before, token)):
                return less + 1
        raise ValueError(f"no token for symbol {symbol}")


class Emitting(Machine):
    """Annotations: the tokens that are final from here on.

    A state's starts each have the tokens before them, from the last emitted one (or START) on.
    """

    first, nothing = ((0, (START,)),), ()

    def move(self, state: tuple, symbol: int) -> tuple[tuple, tuple[int, ...]]:
        nodes, starts, last = self.nodes, [], None
        for node, chain in state:
            nxt = nodes[node].get(symbol)
            if nxt is None:
                continue
            if nodes[nxt]:
                starts.append((nxt, chain))
            if last is None:
                token = self.token_at[nxt]
                if token != START and (chain[-1] == START or self.fits(chain[-1], token)):
                    last = (*chain, token)
        if last is None:
            raise ValueError(f"no token for symbol {symbol}")
        common = len(last)
        for _, chain in starts:
            common = min(common, len(chain))
            while chain[:common] != last[:common]:
                common -= 1
        keep = common - 1
        return (*[(n, c[keep:]) for n, c in starts], (0, last[keep:])), last[1:common]

    def last(self, state: tuple, symbol: int) -> tuple[int, ...]:
        """The tokens that are left when this is the pretoken's last symbol."""
        for node, chain in state:
            nxt = self.nodes[node].get(symbol)
            if nxt is not None and (token := self.token_at[nxt]) != START and (chain[-1] == START or self.fits(chain[-1], token)):
                return (*chain[1:], token)
        raise ValueError(f"no token for symbol {symbol}")


class Walk:
    """The splitter and a machine as one transducer over characters.

    Its state is the splitter's state, the last byte (it may be a word's last, which is another symbol) and the
    machine's state.
    """

    def __init__(self, splitter: Splitter, machine: Machine):
        self.splitter, self.machine = splitter, machine
        self.first = self.state = (FREE, -1, machine.first)

    def feed(self, chars: Iterable[str]) -> list:
        """The annotations of the transitions, without those that are nothing."""
        mode, parts = self.state[0], []
        for c in chars:
            mode, more = self.splitter.step(mode, c)
            parts += more
        return self._apply(mode, parts)

    def end(self) -> list:
        """The annotations that the end of the text brings; then ready for another one."""
        return self._apply(FREE, self.splitter.ending(self.state[0]))

    def _apply(self, mode: str | tuple, parts: Iterable[bytes | None]) -> list:
        machine, (_, last, key), out = self.machine, self.state, []
        at, inner = machine.place(key), machine.inner
        for part in parts:
            for byte in part or ():
                if last >= 0:
                    at, made = machine.moves[at].get(inner[last]) or machine.step(at, inner[last])
                    if made:
                        out.append(made)
                last = byte
            if part is None:
                out.append(machine.last(machine.states[at], machine.final[last]))
                last, at = -1, 0
        self.state = (mode, last, machine.states[at])
        return out


def machine(kind: type[Machine], path: str) -> Machine:
    """One for each worker process, kind and file, while it works for the same operator."""
    return held((kind, path), lambda: kind(path))
