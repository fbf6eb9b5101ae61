"""Fixed values that results depend on."""

# Band order of a scene, the bands that are delivered, and where those go among eleven.
BANDS = ("B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B11", "B12")
DELIVERED = ("B02", "B03", "B04", "B05", "B08", "B8A", "B11", "B12")
EMPTY_BANDS = (0, 5, 6)
BAND_MEANS = (0.057, 0.054, 0.046, 0.036, 0.033, 0.041, 0.049, 0.043, 0.050, 0.031, 0.019)
BAND_STDS = (0.010, 0.010, 0.013, 0.010, 0.012, 0.020, 0.030, 0.020, 0.030, 0.020, 0.013)
# Tiles, thresholds, areas in square metres.
PATCH, OVERLAP = 256, 32
DEBRIS_THRESHOLD, STRICT_THRESHOLD, DEBRIS_BOOST = 0.10, 0.25, 0.5
MIN_AREA, MAX_AREA = 100.0, 5e7
# Class names by index 0 to 14 (files have 1 to 15), with the polymer name and whether it is no debris.
CLASSES = (
    ("Marine Debris", "Marine Debris (Plastic)", False),
    ("Dense Sargassum", "Organic Matter (Sargassum)", False),
    ("Sparse Sargassum", "Organic Matter (Sparse Sargassum)", False),
    ("Natural Organic Material", "Organic Matter (NOM)", False),
    ("Ship", "False Positive (Ship)", True),
    ("Clouds", "False Positive (Cloud)", True),
    ("Marine Water", "False Positive (Water)", True),
    ("Sediment-Laden Water", "False Positive (Sediment)", True),
    ("Foam", "Organic Matter (Foam)", False),
    ("Turbid Water", "False Positive (Turbid Water)", True),
    ("Shallow Water", "False Positive (Shallow Water)", True),
    ("Waves", "False Positive (Waves)", True),
    ("Cloud Shadows", "False Positive (Cloud Shadow)", True),
    ("Wakes", "False Positive (Wake)", True),
    ("Mixed Water", "False Positive (Mixed Water)", True),
)
N_CLASSES = len(CLASSES)
# Wavelengths in nm of red, near infrared and short-wave infrared.
WL_RED, WL_NIR, WL_SWIR = 665, 832, 1610
# Drift. Shares of current and wind, particles, hours, density clustering.
CURRENT_SHARE, WIND_SHARE, PARTICLES, HOURS, EPS, MIN_SAMPLES = 0.97, 0.03, 50, 720, 0.5, 5
METRES_PER_DEGREE, KM_PER_DEGREE = 111_000.0, 111.0
# Attribution weights in the order that breaks ties, and the search radius.
WEIGHTS = {"fishing": 0.4, "industrial": 0.3, "shipping": 0.2, "river": 0.1}
RADIUS_KM, RIVER_KM = 10.0, 200.0
# River mouths (name, lon, lat).
RIVERS = (
    ("Ganges", 88.8, 21.7), ("Indus", 67.5, 23.9), ("Mekong", 106.7, 9.8), ("Yangtze", 121.9, 31.4), ("Nile", 31.5, 31.5),
    ("Niger", 6.0, 4.3), ("Amazon", -50.0, -0.5), ("Pearl", 113.5, 22.2), ("Mahaweli", 81.3, 8.6), ("Kelani", 79.8, 6.9),
)
# Shipping corridors (lon from, lat from, lon to, lat to), open at the ends.
CORRIDORS = ((60, 5, 120, 25), (-10, 0, 40, 40), (100, 20, 180, 50))
# Named places and countries (name, lon from, lat from, lon to, lat to), the first that fits counts.
PLACES = (("Sri Lankan Coast", 79, 5, 82, 10), ("Bay of Bengal (Bangladesh)", 87, 20, 90, 23), ("Gulf of Thailand", 100, 5, 110, 15))
COUNTRIES = (("Sri Lanka", 79, 5, 82, 10), ("Bangladesh", 87, 20, 93, 27), ("India", 68, 8, 78, 24), ("Thailand/Vietnam", 95, 5, 106, 21))
