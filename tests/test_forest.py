import numpy as np
import pytest

from canopy.operators import graph
from canopy.sources.forest_text import hex_to_levels, levels_to_hex, read_tree, write_tree


def test_text_round_trip():
    text = "1 r 1 0 8 b50 4a0\n2 m -1.0\n3 m 1.0"
    assert sorted(read_tree(text).rules[1].left) == [0, 2, 3, 5, 7]
    assert write_tree(read_tree(text)) == text
    assert hex_to_levels(levels_to_hex({0, 7, 8}, 9), 9) == [0, 7, 8]
    with pytest.raises(ValueError):
        read_tree("1 r 0 0.5 0\n2 m 1")


def test_missing_values_are_not_placed():
    tree = read_tree("1 r 0 0.5 0\n2 m -1\n3 m 1")
    assert np.isnan(tree.evaluate(np.array([[np.nan]]), None, 1)[0])


@pytest.mark.parametrize("kind", range(8))
def test_graph_split_covers_both_sides(kind):
    edges = [(i, i + 1) for i in range(5)] + [(0, 5)]
    left, right = graph.graph_split(range(6), edges, kind, np.random.default_rng(kind))
    assert left and right and sorted(left + right) == list(range(6))


def test_spanning_tree():
    edges = [(i, j) for i in range(5) for j in range(i)]
    tree = graph.spanning_tree(range(5), edges, np.random.default_rng(0))
    assert len(tree) == 4 and len(graph.components_of(range(5), tree)) == 1
