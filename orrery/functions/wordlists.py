"""Word lists and tag rules that decide results."""

# English stop words. Forms with an apostrophe are left out, since tokens never hold punctuation.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn
wasn weren won wouldn
""".split()

# Words that the tokenizer splits in two, with the length of the first part.
SPLIT_WORDS = {"cannot": 3, "gimme": 3, "gonna": 3, "gotta": 3, "lemme": 3, "wanna": 3}

# Substring replacements, in order. The groups below follow. Other rule sets are passed as a table.
TAG_CONTAINS = [
    ("submillimetre", "submillimeter"),
    ("x rays", "x ray"),
    ("catalogues", "catalog"),
    ("catalogs", "catalog"),
    ("astronomical data bases miscellaneous", "catalog"),
    ("celestial objects catalog", "catalog"),
    ("atlases", "catalog"),
    ("surveys", "survey"),
    ("survey galaxies fundamental parameters galaxies statistics", "survey"),
    ("surveys: galaxies: fundamental parameters: galaxies: statistics", "surveys"),
    ("v m", "star clusters"),
    ("ω centauri", "star clusters"),
    ("γ dor", "blue stragglers"),
    ("zodiacal dust", "circumstellar matter"),
    ("supermassive black holes", "black holes"),
    ("chandrasekhar limit", "black holes"),
    ("intermediate mass black holes", "black holes"),
]

# A tag that starts with the first text becomes the second, in order.
TAG_PREFIXES = [
    ("ultraviolet", "ultraviolet"),
    ("submillimeter", "submillimeter"),
    ("radio", "radio"),
    ("infrared", "infrared"),
    ("near infrared", "infrared"),
    ("gamma ray", "gamma ray"),
    ("x ray", "x ray sources"),
    ("planetary systems", "planetary systems"),
    ("protoplanetary", "planetary systems"),
    ("planets", "planetary systems"),
    ("exoplanet", "planetary systems"),
    ("minor planets", "planetary systems"),
]

# Further substring replacements by their target, in order.
TAG_CONTAINS_GROUPS = [
    (
        "stellar studies",
        [
            "red giant stars", "red giants", "white dwarf stars", "hertzsprung russell and c m diagrams",
            "hertzsprung russell and colour magnitude diagrams", "white dwarfs", "wolf rayet stars", "triple stars", "variable stars",
            "variables other", "a stars", "halo stars", "o stars", "ob associations", "ob stars", "symbiotic stars", "supermassive stars",
            "supergiant stars", "neutron stars", "stars: magnetic fields", "tars oscillations", "photosphere", "peculiar stars", "db stars",
            "b stars", "be formation", "subdwarfs", "m dwarf stars", "m stars", "distribution of stars", "blue stars", "blue stragglers",
            "asymptotic giant branch stars", "binary stars", "brown dwarfs", "k stars", "giant stars", "f stars", "first stars",
            "horizontal branch stars", "main sequence stars", "population ii stars", "pre main sequence stars", "eclipsing stellar studies",
            "low mass x ray stellar studies", "post stellar studies", "pre stellar studies", "long period variables", "main sequence",
        ],
    ),
    (
        "statistics",
        [
            "statistical", "statistics computation", "statistics machine learning", "astrostatistics", "spatial distribution", "correlation",
            "tables data", "density distribution", "fluorescence", "flux density",
        ],
    ),
    ("instrumentation", ["very large array vla", "very large telescope", "virtual observatory tools"]),
    ("star clusters", ["young massive clusters"]),
    (
        "galaxies",
        [
            "peculiar galaxies", "nearby galaxies", "compact galaxies", "irregular galaxies", "interacting galaxies", "dwarf galaxies",
            "disk galaxies", "continuum galaxies", "elliptical galaxies", "galaxies", "low surface brightness galaxies",
            "sagittarius dwarf spheroidal galaxy",
        ],
    ),
]

# Further prefixes by their target, in order; a blank at the end counts.
TAG_PREFIX_GROUPS = [
    (
        "astrophysics",
        [
            "astrophysics", "tidal", "cosmology", "gravitational len", "accretion", "methods", "astronomy", "time", "mass to light", "astronomical",
            "thermal emission", "atomic", "celestial mechanics", "polarization", "nuclear ", "high energy", "astroparticle physics",
            "acceleration of particles", "asteroseismology", "magnetic ", "light curve", "line ", "light transmission", "cosmic ", "dark ",
            "electron ", "evolution", "equation", "cosmological parameters", "general relativity and quantum cosmology",
            "primordial nucleosynthesis", "nuclei", "nucleosynthesis", "n body simulations", "large scale structure of universe",
            "many body problem", "relativistic processes", "centimeter waves", "gravitational waves", "shock waves", "missing mass astrophysics",
            "millimiter astronomy", "hst photometry", "electrophotometry", "equipartition theorem", "gravitation",
        ],
    ),
    (
        "astrometry",
        [
            "velocity", "three dimensional", "distance", "parallax", "astrometric", "angular velocity", "techniques", "visual binaries",
            "photographic", "photometric", "luminosity", "kinematics", "superhigh frequencies", "space astrometry", "mass", "absolute magnitude",
            "color ", "orbit determination and improvement", "multiple stars star positions", "reference systems", "reference stars",
            "washington system", "celestial reference systems", "proper motions", "red shift", "radial ", "observational", "occultations",
            "optical", "point sources", "point spread functions", "hydrodynamic", "position location", "photoelectric magnitudes", "faint objects",
        ],
    ),
    (
        "spectral analysis",
        [
            "spectroscopic", "spectral", "spectrum", "photometry", "brightness", "wavelengths", "radiation mechanisms", "visible spectrum", "ubv ",
            "surface photometry", "balmer series", "spectrophotometry", "absorption spectra", "angular resolution", "masers", "water masers",
            "k lines", "emission", "continuous spectra", "continuous radiation", "diffuse radiation", "extragalactic radio sources",
            "far ultraviolet radiation", "key words radiation mechanisms non thermal", "radiant flux density", "radiative transfer", "radio",
            "relic radiation", "temperature gradients",
        ],
    ),
    (
        "stellar studies",
        [
            "stars binaries", "stellar", "stars", "star", "binaries", "astrometric and interferometric binaries", "hertzsprung", "supergiants",
            "stellar studies", "cepheid", "sun ", "young star", "young stellar", "sstellar", "solar", "rr lyrae stellar", "cataclysmic", "dstellar",
        ],
    ),
    (
        "instrumentation",
        [
            "schmidt cameras", "schmidt telescope", "cassegrain", "instrumentation", "telescopes", "cameras", "calibrating", "ccd",
            "satellite borne photography", "hubble", "ligo", "bolometers", "fabry perot interferometers",
        ],
    ),
    ("galaxies", ["galaxy", "galaxies", "galactic", "milky way", "spiral", "seyfert", "barred ", "local group"]),
    ("star clusters", ["orion", "globular", "globular clusters", "open clusters", "clusters", "pleiades", "open cluster", "open star clusters"]),
    (
        "chemistry",
        [
            "carbon", "nitrogen", "neon", "sulfur", "oxygen", "molecular", "hydrogen", "helium", "metallic", "abundance", "argon", "calcium",
            "chemical", "h ", "hii ", "ho ", "neutral hydrogen", "astrochemistry", "reionization",
        ],
    ),
    ("statistics", ["astrostatistics", "statistics", "bayesian ", "sampling", "data "]),
    (
        "black holes",
        [
            "black hole", "astrophysical black holes", "quasars", "active galactic nuclei", "active galaxies", "agb and post agb", "bl lacertae",
        ],
    ),
    ("catalog", ["catalogue", "catalog", "sky survey", "southern sky", "sdss collaboration", "survey"]),
    (
        "novae and supernovae",
        [
            "supernovae", "supernova", "planetary nebulae", "novae", "transients supernovae", "supernovae general", "pulsars", "binary pulsars",
            "core collapse supernovae", "millisecond pulsar", "millisecond pulsars", "compact objects", "dense matter",
        ],
    ),
    ("nebulae", ["nebulae", "reflection nebulae", "filamentary nebulae"]),
    ("interstellar medium", ["ism", "interstellar", "intergalactic medium", "interplanetary medium"]),
    ("early or late types", ["early ", "late "]),
    ("asteroids and meteorids", ["asteroids general", "meteorites", "meteoroids", "meteors"]),
    (
        "data analysis",
        [
            "russell and colour", "hr diagram", "magnitude diagrams", "computer science machine learning", "markov chain monte carlo",
            "image processing", "imaging techniques", "computational methods",
        ],
    ),
]

# Tags that carry no topic.
TAG_IGNORE = [
    "terzan", "sncs", "snbb", "ptfkmb", "ptfdav", "ptfbij", "psr j", "psr b", "p puppis", "omega centauri",
    "ophiuchi clouds", "addenda", "and ic", "babić", "balloons", "car ob", "cgcg", "delta scuti", "melotte",
    "galah collaboration", "gaia collaboration", "dinh v trung", "ddo system", "dark ages", "collinder", "co pis",
    "clouds", "chi persei", "chronology", "magellanic clouds", "jcmt gould belt survey team",
    "request for observations", "individual galaxies m", "individual ic", "individual m", "berkeley", "m group",
    "dlt collaboration", "cygnus constellation", "crab nebula", "gum nebula", "gould belt", "equatorial regions",
    "photon dominated region pdr", "polar regions", "regions", "lodén", "classifications", "eclipses", "errata",
    "forbidden transitions", "herbig ae be", "spirits buu", "mergers", "mapping", "lunar occultation", "reliability",
    "outflows", "northern hemisphere", "northern sky", "morphology", "epic", "error analysis", "scattering",
    "mindstep consortium", "magic collaboration", "magnetohydrodynamics mhd", "lcogt robonet consortium",
    "hitomi collaboration", "harmonics", "retrograde orbits", "dust", "extinction", "extra planar gas", "dynamics",
    "formaldehyde", "charge coupled devices", "centroids", "atmospheric effects", "gas collaboration", "frequencies",
    "frequency distribution", "normal density functions", "high resolution", "instabilities", "interactions",
    "linear polarization", "luminous intensity", "periodic variations", "scaling relations", "synthetic apertures",
    "transient",
]
