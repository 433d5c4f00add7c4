import numpy as np
import pytest

from viewlake.functions import kernels as K


def tile(g):
    return np.repeat(np.asarray(g, np.uint8)[None, ..., None], 3, axis=3)


def checker(h, w):
    return tile([[255 * ((x + y) % 2 == 0) for x in range(w)] for y in range(h)])


# Values from an independent model of the same rules, for the 4x4 and 6x4 patterns
@pytest.mark.parametrize(
    ("image", "hash_hex", "blur", "noise", "sky"),
    [
        (checker(4, 4), "cccc3333cccc3333", 1040400.0, 0.5, 0.0),
        (tile([[255 * (x // 2 == y // 2) for x in range(4)] for y in range(4)]), "f0f0f0f00f0f0f0f", 97537.5, 0.3418, 0.5),
        (tile([[255 * ((x in (0, 3)) == (y in (0, 3))) for x in range(4)] for y in range(4)]), "c3c33c3c3c3cc3c3", 617737.5, 0.498, 0.0),
        (checker(4, 6), "9696696996966969", 1040400.0, 0.5, 0.0),
        (checker(6, 4), "cc3333cc33cccc33", 1040400.0, 0.5, 0.0),
    ],
)
def test_small_patterns(image, hash_hex, blur, noise, sky):
    assert f"{K.average_hash(image[0]):016x}" == hash_hex
    assert K.blur_score(image)[0] == pytest.approx(blur, rel=1e-3)
    assert K.noise_score(image)[0] == pytest.approx(noise, abs=1e-3)
    assert K.sky_reflective_ratio(image)[0] == pytest.approx(sky, abs=1e-3)
    mean, std = K.exposure(image)
    assert (mean[0], std[0], K.clipped_ratio(image)[0]) == pytest.approx((0.5, 0.5, 0.5))


def test_levels_and_shares():
    assert K.exposure(tile(np.full((16, 16), 20)))[0][0] < 0.2 and K.exposure(tile(np.full((16, 16), 230)))[0][0] > 0.8
    corner = np.zeros((20, 20))
    corner[:10, :10] = 255
    assert K.clipped_ratio(tile(corner))[0] == 0.25
    band = np.zeros((20, 20))
    band[:12] = 220
    assert K.sky_reflective_ratio(tile(band))[0] == pytest.approx(0.6)
    flat, rough = np.full((32, 32), 127), np.random.default_rng(42).integers(0, 256, (32, 32))
    assert K.noise_score(tile(flat))[0] == 0 < K.noise_score(tile(rough))[0]


def test_sharp_above_blurred():
    sharp = np.zeros((32, 32))
    sharp[:, :16] = 255
    soft = np.apply_along_axis(lambda r: np.convolve(np.pad(r, 4, mode="edge"), np.ones(9) / 9, "valid"), 1, sharp)
    assert K.blur_score(tile(sharp))[0] > 10 * K.blur_score(tile(soft))[0]


def test_uniform_images_hash_to_zero_and_thin_images_work():
    assert K.average_hash(tile(np.full((9, 9), 255))[0]) == 0
    for shape in ((1, 1), (1, 7), (7, 1), (2, 2)):
        m = K.measures(tile(np.full(shape, 90)))
        assert m["blur_score"][0] == 0 and m["noise_score"][0] == 0


def test_stack_equals_single():
    stack = np.random.default_rng(1).integers(0, 256, (5, 9, 11, 3)).astype(np.uint8)
    whole = K.measures(stack)
    for i in range(5):
        for name, values in K.measures(stack[i : i + 1]).items():
            assert values[0] == whole[name][i]
