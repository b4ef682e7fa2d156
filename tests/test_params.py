import pytest

from stratavox.params import Params


def test_derived_values():
    a = Params.of({"map": {"max_distance": 3, "resolution": 1000, "size": {"x": 20, "y": 20, "z": 20}, "filename": "/tmp/t.h5"}, "registration": {"max_iterations": 300, "epsilon": 0.05}})
    assert a.map.metadata() == {"tau": 3000, "map_size_x": 20, "map_size_y": 20, "map_size_z": 20, "max_distance": 3.0, "map_resolution": 1000, "max_weight": 640}
    assert a.map.odd_cells == (21, 21, 21) and a.map.initial_weight == 0 and a.map.path == "/tmp/t"
    assert a.registration.max_iterations == 300 and a.registration.epsilon == 0.05
    b = Params.of({"map": {"max_distance": 4, "resolution": 4000}})
    assert b.map.tau == 4000 and b.map.cells[:2] == (5, 5)
    c = Params()
    assert c.map.tau == 600 and c.map.cells == (312, 312, 78)


def test_yaml_and_errors(tmp_path):
    f = tmp_path / "p.yaml"
    f.write_text("floam:\n  enrich: 5\nmap:\n  size:\n    z: 9\n")
    p = Params.load(str(f))
    assert p.floam.enrich == 5 and p.map.size == {"x": 20, "y": 20, "z": 9}
    with pytest.raises(KeyError):
        Params.of({"map": {"nothing": 1}})
    with pytest.raises(KeyError):
        Params.of({"nothing": {}})
