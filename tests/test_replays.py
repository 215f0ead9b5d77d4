"""Replays that lack candidates."""

from jostle.operators import runs as R


def test_missing_replays_count_as_disagreement(rows):
    schema = "source_id long, cand long, transition_code int, candidate_prediction int, clean_prediction int"
    full = [(1, 0, 1, 2, 0), (1, 1, 1, 3, 0), (2, 0, 2, 0, 1), (2, 1, 0, 1, 1)]
    got = {r["transition_code"]: r for r in R.replay_agreement(rows(schema, full), {"x": rows(schema, full[1:]), "y": rows(schema, full[:2])}).collect()}
    assert (got[1]["candidates"], got[1]["missing_x"], got[1]["missing_y"], got[1]["label_agreement"], got[1]["x_same_class"]) == (2, 1, 0, 0.5, 1)
    assert (got[2]["candidates"], got[2]["missing_x"], got[2]["missing_y"], got[2]["label_agreement"]) == (1, 0, 1, 0.0)
    assert (got[None]["candidates"], got[None]["missing_x"], got[None]["missing_y"], got[None]["x_same_type"]) == (3, 1, 1, 2)
