"""What the near-duplicate join sends to tiles for a dense group, and its links all the same."""

from brute import near_groups
from test_operators import by_repr, sorted_rows, variants

from quillstream.llm import op06_chosen_path


def test_a_dense_group_gives_rows_in_proportion(docs, monkeypatch):
    monkeypatch.setattr(op06_chosen_path, "TILE", 8)
    monkeypatch.setattr(op06_chosen_path, "SPLIT_ABOVE", 24)
    counted = []
    sift = op06_chosen_path.candidates

    def counting(rows, *args):
        counted.append(rows.count())
        return sift(rows, *args)

    monkeypatch.setattr(op06_chosen_path, "candidates", counting)
    rows = variants(240, 150, 6) + [(1000 + d, f"alone {' '.join(f'v{d * 30 + k}' for k in range(20))}") for d in range(40)]
    frame = docs(rows, clashes=False)
    assert sorted_rows(op06_chosen_path.near_duplicates(frame)) == by_repr(near_groups(rows))
    # Blocks of eight met pairwise would be 240 * 240 / 8 rows a tree; here each class meets one and some pivots.
    assert counted[0] <= 3 * len(rows) and max(counted) < 11 * 240 * 240 / 8 / 5


def test_groups_of_one_node_that_are_no_copies_of_each_other(docs, monkeypatch):
    monkeypatch.setattr(op06_chosen_path, "TILE", 8)
    monkeypatch.setattr(op06_chosen_path, "SPLIT_ABOVE", 10_000)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = []
    for group in range(6):
        for doc_id, text in variants(30, 40, 4, seed=group):
            rows.append((group * 100 + doc_id, f"{passage} {text}"))
    assert sorted_rows(op06_chosen_path.near_duplicates(docs(rows, clashes=False))) == by_repr(near_groups(rows))
