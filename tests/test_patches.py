from fringework.operators import geometry as T


def test_a_raster_smaller_than_the_patch_has_none():
    assert T.patch_origins(10, 32, 8) == [] and T.patch_origins(32, 32, 8) == [0] and T.patch_origins(35, 32, 8) == [0, 3]
