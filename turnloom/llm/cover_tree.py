"""Cover trees over unit vectors and the dual traversal that finds all close pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TILE = 1024


@dataclass
class Node:
    """A ball: all members lie within `radius` of vector `center`; children lie within the parent's ball."""

    center: int
    radius: float
    members: np.ndarray
    children: list[Node] | None = None


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _net(x: np.ndarray, members: np.ndarray, first: int, reach: float) -> list[tuple[int, np.ndarray, float]]:
    """Centers more than `reach` apart, and the members nearest to each within reach.

    Centers are found in batches: a small matrix separates a batch, one product
    hands the members out.
    """
    found, rest = [], np.concatenate(([first], members[members != first]))
    while len(rest):
        batch = rest[:256]
        near = _distances(x[batch], x[batch]) <= reach
        picked: list[int] = []
        taken = np.zeros(len(batch), bool)
        for i in range(len(batch)):
            if not taken[i]:
                picked.append(i)
                taken |= near[i]
        centers = batch[picked]
        left, owners, far = [], [], []
        for a in range(0, len(rest), TILE):
            d = _distances(x[rest[a : a + TILE]], x[centers])
            owner = d.argmin(1)
            gap = d[np.arange(len(d)), owner]
            inside = gap <= reach
            left.append(~inside)
            owners.append(owner)
            far.append(gap)
        left, owners, far = np.concatenate(left), np.concatenate(owners), np.concatenate(far)
        own = np.array(picked)  # the batch is the start of rest; a center belongs to itself
        left[own], owners[own], far[own] = False, np.arange(len(centers)), 0.0
        inside = ~left
        order = np.argsort(owners[inside], kind="stable")
        own, who, gap = owners[inside][order], rest[inside][order], far[inside][order]
        cut = np.searchsorted(own, np.arange(len(centers) + 1))
        found += [(int(c), who[a:b], float(gap[a:b].max(initial=0.0))) for c, a, b in zip(centers, cut[:-1], cut[1:], strict=True)]
        rest = rest[left]
    return found


def build(x: np.ndarray, members: np.ndarray | None = None, leaf: int = 24, smallest: float = 1e-3) -> Node:
    """A tree over unit vectors x; radii at least halve from level to level."""
    members = np.arange(len(x)) if members is None else members
    center = int(members[0])
    root = Node(center, float(_distances(x[members], x[center : center + 1]).max()), members)
    waiting = [root]
    while waiting:
        node = waiting.pop()
        if len(node.members) <= leaf or node.radius <= smallest:
            continue
        node.children = [Node(c, r, m) for c, m, r in _net(x, node.members, node.center, node.radius / 2)]
        waiting += node.children
    return root


def leaves(root: Node) -> list[Node]:
    """The balls that no level splits on; each member is in one of them."""
    found, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        if node.children is None:
            found.append(node)
        else:
            waiting += node.children
    return found


def _singletons(node: Node) -> list[Node]:
    return node.children if node.children is not None else [Node(int(m), 0.0, np.array([m])) for m in node.members]


def close_pairs(x: np.ndarray, one: Node, y: np.ndarray, two: Node, threshold: float):
    """Yields (i, j) index arrays of all pairs with x[i] . y[j] >= threshold.

    With one the same as two, each pair comes at least once in one order, and
    with itself. Node pairs farther apart than their radii and the reach allow
    are dropped; the slack covers rounding.
    """
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-7
    same = one is two
    waiting = [(one, two)]
    while waiting:
        a, b = waiting.pop()
        if len(a.members) == 1 and len(b.members) == 1:
            left, right = [a], [b]
        else:
            left = _singletons(a) if len(a.members) > 1 else [a]
            right = _singletons(b) if len(b.members) > 1 else [b]
        ca, cb = np.array([n.center for n in left]), np.array([n.center for n in right])
        ra, rb = np.array([n.radius for n in left]), np.array([n.radius for n in right])
        na, nb = np.array([len(n.members) for n in left]), np.array([len(n.members) for n in right])
        for s in range(0, len(left), TILE):
            for t in range(s if same and a is b else 0, len(right), TILE):
                dots = x[ca[s : s + TILE]] @ y[cb[t : t + TILE]].T
                d = np.sqrt(np.maximum(2 - 2 * dots, 0))
                near = d <= ra[s : s + TILE, None] + rb[None, t : t + TILE] + reach
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                if same and a is b and s == t:
                    keep = i <= j
                    i, j = i[keep], j[keep]
                single = (na[s + i] == 1) & (nb[t + j] == 1)
                hit = single & (dots[i, j] >= threshold)
                if hit.any():
                    yield ca[s + i[hit]], cb[t + j[hit]]
                waiting += [(left[s + p], right[t + q]) for p, q in zip(i[~single].tolist(), j[~single].tolist(), strict=True)]
