import math

from lagweave.operators.curvefit import rebuild

# ---- fixed values: knots, the temperature of least risk, and ten points (temperature, relative risk) of published
# ---- curves of ten regions, whose logarithms are splines of degree 2 ------------------------------------------------
CURVES = {
    "East": ((3.315, 14.9031, 17.721), 18.0388446, [(-4.0, 2.42511496), (-0.8, 1.46246974), (2.4, 1.16641145), (5.7, 1.14146909), (8.9, 1.11641731), (12.1, 1.07822714), (15.3, 1.02865082), (18.6, 1.00209874), (21.8, 1.1319534), (25.0, 1.54154795)]),
    "East Midlands": ((3.0404, 14.2568, 16.9849), 16.5321922, [(-5.0, 2.51850268), (-1.8, 1.50301496), (1.4, 1.16331168), (4.7, 1.12942959), (7.9, 1.1145155), (11.1, 1.07803029), (14.3, 1.02211077), (17.6, 1.00442825), (20.8, 1.07329053), (24.0, 1.24142093)]),
    "London": ((4.3955, 15.9729, 18.9443), 20.1218669, [(-3.0, 2.18649184), (0.6, 1.44102508), (4.1, 1.21465174), (7.7, 1.16984176), (11.2, 1.12891449), (14.8, 1.08845933), (18.3, 1.03259348), (21.9, 1.05366029), (25.4, 1.51684555), (29.0, 3.16827315)]),
    "North East": ((3.0888, 13.3578, 15.9498), 15.3286567, [(-5.0, 2.5584308), (-1.9, 1.48877185), (1.2, 1.13392029), (4.3, 1.1050142), (7.4, 1.10598695), (10.6, 1.07431697), (13.7, 1.0154459), (16.8, 1.00786744), (19.9, 1.04339072), (23.0, 1.10165803)]),
    "North West": ((3.6001, 14.2079, 16.6217), 16.8241409, [(-6.0, 2.45682175), (-2.6, 1.56233016), (0.9, 1.20436326), (4.3, 1.13697982), (7.8, 1.12279075), (11.2, 1.08255219), (14.7, 1.01808975), (18.1, 1.0088956), (21.6, 1.12779758), (25.0, 1.42014556)]),
    "South East": ((3.6707, 15.0261, 17.7077), 17.9146170, [(-4.0, 2.56007607), (-0.8, 1.53718507), (2.4, 1.19697964), (5.7, 1.14993039), (8.9, 1.11721949), (12.1, 1.07411957), (15.3, 1.02215737), (18.6, 1.00431089), (21.8, 1.13270336), (25.0, 1.50681411)]),
    "South West": ((4.3103, 14.6727, 17.0828), 16.1406197, [(-4.0, 2.88660829), (-0.9, 1.69839599), (2.2, 1.26165), (5.3, 1.16850934), (8.4, 1.13066907), (11.6, 1.07771495), (14.7, 1.0149438), (17.8, 1.01837526), (20.9, 1.08565435), (24.0, 1.18759958)]),
    "Wales": ((4.1584, 14.3116, 16.6367), 15.8675085, [(-3.0, 2.28736815), (0.0, 1.46980581), (3.0, 1.18731427), (6.0, 1.15118139), (9.0, 1.11771316), (12.0, 1.06701055), (15.0, 1.00543769), (18.0, 1.02239647), (21.0, 1.08077194), (24.0, 1.16859528)]),
    "West Midlands": ((3.0586, 14.2751, 16.9781), 17.2285853, [(-5.0, 2.60302585), (-1.7, 1.49843787), (1.7, 1.14790875), (5.0, 1.1266605), (8.3, 1.11189599), (11.7, 1.07330587), (15.0, 1.01754458), (18.3, 1.0058131), (21.7, 1.1097271), (25.0, 1.37132422)]),
    "Yorkshire & Humber": ((3.0825, 14.0194, 16.6744), 16.0299081, [(-4.0, 2.13117296), (-1.0, 1.38227072), (2.0, 1.13733899), (5.0, 1.12628603), (8.0, 1.11199297), (11.0, 1.07637724), (14.0, 1.02149465), (17.0, 1.00461918), (20.0, 1.05276192), (23.0, 1.15270755)]),
}
# --------------------------------------------------------------------------------------------------------------------


def curves(spark):
    """Every curve on its grid of tenths: {region: {temperature: relative risk}}, and at its temperature of least risk."""
    points = spark.createDataFrame([(g, t, math.log(rr)) for g, (_, _, ps) in CURVES.items() for t, rr in ps], "region string, t double, y double")
    knots = spark.createDataFrame([(g, list(k), ps[0][0], ps[-1][0]) for g, (k, _, ps) in CURVES.items()], "region string, knots array<double>, lo double, hi double")
    grid = [(g, v) for g, (_, mmt, ps) in CURVES.items() for v in (*(ps[0][0] + i / 10 for i in range(round((ps[-1][0] - ps[0][0]) * 10) + 1)), mmt)]
    got = rebuild(points, spark.createDataFrame(grid, "region string, t double"), "region", "t", "y", knots, 3).collect()
    out = {}
    for r in got:
        out.setdefault(r.region, {})[round(r.t, 7)] = math.exp(r.fit)
    return out


def test_published_curves(spark):
    """The ten points of each curve come back, and the risk at its temperature of least risk, which is none of them, is 1."""
    got = curves(spark)
    for g, (_, mmt, points) in CURVES.items():
        assert len(got[g]) == round((points[-1][0] - points[0][0]) * 10) + 2
        assert all(abs(got[g][t] - rr) < 1e-5 for t, rr in points)
        assert abs(got[g][round(mmt, 7)] - 1) < 1e-5


def test_series_without_knots_or_points(spark):
    points = spark.createDataFrame([("a", float(i), i * i / 10) for i in range(12)] + [("b", 1.0, 2.0), ("c", 1.0, 1.0)], "g string, x double, y double")
    knots = spark.createDataFrame([("a", [3.0, 7.0], 0.0, 11.0), ("b", [0.5, 0.7], 0.0, 2.0)], "g string, knots array<double>, lo double, hi double")
    at = spark.createDataFrame([("a", 4.5), ("a", None), ("b", 1.0), ("c", 1.0), ("d", 1.0), (None, 1.0)], "g string, x double")
    got = sorted(rebuild(points, at, "g", "x", "y", knots, 2).collect(), key=lambda r: (r.g or "", r.x or 0))
    assert [r.fit for r in got if r.g != "a"] == [None] * 4 and got[1].fit is None
    assert math.isclose(got[2].fit, 2.025, abs_tol=1e-9)
