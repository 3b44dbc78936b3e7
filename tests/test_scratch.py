from threading import Barrier, Thread

from genoflux import scratch


def test_runs_side_by_side(spark):
    left, both = {}, Barrier(2)

    def work(name):
        scratch.begin_run()
        since = scratch.mark()
        mine = []
        for k in range(3):
            both.wait()
            mine.append(scratch.materialise(spark.range(k + 1), f"{name}-{k}"))
        both.wait()
        scratch.drop_since(since, keep=1)
        both.wait()
        left[name] = mine[-1].count()

    threads = [Thread(target=work, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert left == {"a": 3, "b": 3}
