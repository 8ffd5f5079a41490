"""Image kernels on pictures of known answer."""

import numpy as np

from foliant.operators import images, kernels


def test_constant_images_stay():
    flat = np.full((20, 30), 90, dtype=np.uint8)
    assert (kernels.bilateral(flat, 9, 75, 75) == 90).all()
    assert (kernels.adaptive(flat, 11, 2) == 255).all()
    assert np.ptp(kernels.clahe(flat, 2.0)) == 0


def test_clahe_widens_contrast():
    low = np.tile(np.linspace(100, 130, 64).astype(np.uint8), (512, 8))
    assert kernels.clahe(low, 3.0).std() > 2 * low.std()
    assert kernels.clahe(low[:13, :9], 2.0).shape == (13, 9)


def test_bilateral_keeps_edges():
    step = np.repeat([[0] * 10 + [255] * 10], 12, axis=0).astype(np.uint8)
    assert (kernels.bilateral(step, 5, 10, 50) == step).all()


def test_adaptive_finds_ink_under_a_gradient():
    page = np.tile(np.linspace(120, 250, 60), (40, 1))
    page[20, 5:55] -= 80
    out = kernels.adaptive(page.astype(np.uint8), 15, 8)
    assert (out[20, 8:52] == 0).all() and (out[5] == 255).all()


def test_morphology():
    dot = np.zeros((7, 7), dtype=np.uint8)
    dot[3, 3] = 255
    grown = kernels.dilate(dot, 3, 5)
    assert grown.sum() == 255 * 15 and (kernels.erode(grown, 3, 5) == dot).all()
    hole = np.full((9, 9), 255, dtype=np.uint8)
    hole[4, 4] = 0
    assert (kernels.close(hole) == 255).all() and not kernels.open_(dot).any()


def test_skew():
    page = np.full((200, 300), 255, dtype=np.uint8)
    page[60:140, 50:250] = 0
    assert kernels.skew(page == 0) == 0
    for angle in (-3.0, 4.0):
        turned = kernels.rotate(page, -angle)
        assert abs(kernels.skew(turned < 128) - angle) < 0.5
        assert abs(kernels.skew(kernels.deskew(np.where(turned < 128, 0, 255).astype(np.uint8)) < 128)) < 0.5
    far = np.where(kernels.rotate(page, 20.0) < 128, 0, 255).astype(np.uint8)
    assert (kernels.deskew(far) == far).all() and abs(kernels.skew(kernels.deskew(far, None) < 128)) < 0.6
    assert (kernels.deskew(np.full((5, 5), 255, dtype=np.uint8)) == 255).all()


def test_boxes():
    mask = np.zeros((10, 12), dtype=bool)
    mask[1:3, 1:4] = True
    mask[3, 4] = True  # by its corner
    mask[6:9, 8] = mask[8, 5:9] = mask[6:9, 5] = True  # two runs that meet below
    assert kernels.boxes(mask).tolist() == [[1, 1, 4, 3], [5, 6, 4, 3]]
    assert kernels.boxes(np.zeros((4, 4), dtype=bool)).shape == (0, 4)


def test_proposals_and_steps():
    page = np.full((120, 200), 240, dtype=np.uint8)
    page[20:28, 20:120] = page[80:88, 40:180] = 10
    assert len(images.propose(page)) == 2
    for steps in (*images.TIERS.values(), *images.RETRIES.values(), images.BEFORE_OCR):
        out = page
        for step in steps:
            out = step(out)
        assert out.shape == page.shape and set(np.unique(out)) <= {0, 255} and (out[22:26, 60:100] == 0).any()


def test_unreadable(spark):
    rows = [(0, "poor", 4, 4, 1, bytes(range(16))), (1, "good", 4, 4, 1, b"x"), (2, "none", 4, 4, 1, None)]
    df = spark.createDataFrame(rows, "page_id long, tier string, height int, width int, channels int, data binary")
    got = {r["page_id"]: r for r in images.preprocess(df, "page_id").collect()}
    assert got[0]["error"] is None and got[1]["error"] and got[2]["error"] and got[1]["data"] is None
    assert {r["page_id"] for r in images.regions(df, "page_id").collect()} <= {0}
