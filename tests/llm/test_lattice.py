"""Groups of near vectors have links with the square of their size; none of their tables is sent to the driver."""

import numpy as np

from cohortweave.llm import components, lattice


def test_links_are_never_broadcast(spark, monkeypatch):
    rng, plans = np.random.default_rng(3), []
    base = rng.standard_normal(16)
    near = [(i, [float(x) for x in base * (1 + 0.005 * rng.standard_normal(16))], 1) for i in range(60)]
    far = [(100 + i, [float(x) for x in rng.standard_normal(16)], 1) for i in range(20)]
    df = spark.createDataFrame(near + far, "vec_id long, embedding array<double>, label int")
    for module in (lattice, components):
        def recorded(rows, name, save=module.save, **_):
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
            return save(rows, name)

        monkeypatch.setattr(module, "save", recorded)
    out = lattice.linked(df)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 6 and any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]
    got = {r["row_"]["vec_id"]: (r["n_links"], r["component_id"]) for r in out.collect()}
    assert got[7] == (59, 0) and got[105] == (0, 105)
