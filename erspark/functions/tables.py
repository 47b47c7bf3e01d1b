"""Fixed values that normalisation depends on; every function takes a replacement as a parameter."""

# Legal suffixes of business names and their canonical forms.
LEGAL_SUFFIXES = {
    "incorporated": "inc", "inc": "inc", "corporation": "corp", "corp": "corp", "company": "co", "co": "co",
    "limited": "ltd", "ltd": "ltd", "llc": "llc", "llp": "llp", "lp": "lp", "private": "pvt", "pvt": "pvt",
    "plc": "plc", "gmbh": "gmbh", "sa": "sa", "sarl": "sarl", "sas": "sas", "bv": "bv", "nv": "nv", "pty": "pty",
    "group": "group", "holdings": "holdings", "trust": "trust", "foundation": "fdn", "enterprises": "ent",
    "industries": "ind", "international": "intl", "solutions": "sol", "services": "svc",
}

# Spellings of countries.
COUNTRIES = {
    "us": "US", "usa": "US", "u.s.": "US", "u.s.a.": "US", "united states": "US", "united states of america": "US",
    "india": "India", "in": "India", "bharat": "India", "france": "France", "fr": "France",
}

# Postal codes, the last match of which counts; groups are joined.
POSTCODES = {
    "India": r"(?<!\d)([1-9]\d{2})\s?(\d{3})(?!\d)",
    "US": r"(?<!\d)(\d{5})(?:-\d{4})?(?!\d)",
    "France": r"(?<!\d)(\d{5})(?!\d)",
}

# Regions of each country, with their codes and other spellings.
REGIONS = {
    "US": {
        "alabama": ["al"], "alaska": ["ak"], "arizona": ["az"], "arkansas": ["ar"], "california": ["ca", "calif"], "colorado": ["co"],
        "connecticut": ["ct"], "delaware": ["de"], "district of columbia": ["dc", "washington dc"], "florida": ["fl"], "georgia": ["ga"],
        "hawaii": ["hi"], "idaho": ["id"], "illinois": ["il"], "indiana": ["in"], "iowa": ["ia"], "kansas": ["ks"], "kentucky": ["ky"],
        "louisiana": ["la"], "maine": ["me"], "maryland": ["md"], "massachusetts": ["ma"], "michigan": ["mi"], "minnesota": ["mn"],
        "mississippi": ["ms"], "missouri": ["mo"], "montana": ["mt"], "nebraska": ["ne"], "nevada": ["nv"], "new hampshire": ["nh"],
        "new jersey": ["nj"], "new mexico": ["nm"], "new york": ["ny"], "north carolina": ["nc"], "north dakota": ["nd"], "ohio": ["oh"],
        "oklahoma": ["ok"], "oregon": ["or"], "pennsylvania": ["pa"], "rhode island": ["ri"], "south carolina": ["sc"],
        "south dakota": ["sd"], "tennessee": ["tn"], "texas": ["tx"], "utah": ["ut"], "vermont": ["vt"], "virginia": ["va"],
        "washington": ["wa"], "west virginia": ["wv"], "wisconsin": ["wi"], "wyoming": ["wy"], "puerto rico": ["pr"],
    },
    "India": {
        "andhra pradesh": ["ap"], "arunachal pradesh": ["ar"], "assam": ["as"], "bihar": ["br"], "chhattisgarh": ["cg", "ct", "chattisgarh"],
        "goa": ["ga"], "gujarat": ["gj", "gujrat"], "haryana": ["hr"], "himachal pradesh": ["hp"], "jharkhand": ["jh"],
        "karnataka": ["ka", "karnatka"], "kerala": ["kl"], "madhya pradesh": ["mp"], "maharashtra": ["mh", "maharastra"], "manipur": ["mn"],
        "meghalaya": ["ml"], "mizoram": ["mz"], "nagaland": ["nl"], "odisha": ["od", "or", "orissa"], "punjab": ["pb"], "rajasthan": ["rj"],
        "sikkim": ["sk"], "tamil nadu": ["tn", "tamilnadu"], "telangana": ["tg", "ts"], "tripura": ["tr"], "uttar pradesh": ["up"],
        "uttarakhand": ["uk", "uttaranchal"], "west bengal": ["wb"], "delhi": ["dl", "new delhi"], "jammu and kashmir": ["jk"],
        "ladakh": ["la"], "chandigarh": ["ch"], "puducherry": ["py", "pondicherry"], "andaman and nicobar islands": ["an"],
        "dadra and nagar haveli and daman and diu": ["dd"], "lakshadweep": ["ld"],
    },
    "France": {
        "ile-de-france": ["idf", "ile de france"], "auvergne-rhone-alpes": ["ara", "rhone alpes"],
        "bourgogne-franche-comte": ["bfc", "franche comte", "bourgogne"], "bretagne": ["bzh", "brittany"], "centre-val de loire": ["cvl"],
        "corse": ["corsica"], "grand est": ["alsace", "lorraine", "champagne ardenne"], "hauts-de-france": ["hdf", "nord pas de calais", "picardie"],
        "normandie": ["normandy"], "nouvelle-aquitaine": ["aquitaine"], "occitanie": ["languedoc roussillon", "midi pyrenees"],
        "pays de la loire": ["pdl"], "provence-alpes-cote d'azur": ["paca", "provence alpes cote d azur"], "guadeloupe": [], "martinique": [],
        "guyane": ["french guiana"], "la reunion": ["reunion"], "mayotte": [],
    },
}


def region_rows() -> list[tuple[str, str, str]]:
    """(country, spelling, canonical name) of every region name and code."""
    return [(country, spelling, name) for country, names in REGIONS.items() for name, others in names.items() for spelling in (name, *others)]


def long_region_rows() -> list[tuple[str, str]]:
    """(spelling, canonical name) of spellings of more than three characters, which hold for any country; the last country's count."""
    return list({spelling: name for _, spelling, name in region_rows() if len(spelling) > 3}.items())
