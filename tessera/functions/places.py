"""Countries, and regions of countries that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names by country code.
COUNTRY_NAMES = {
    "tr": "Türkiye", "de": "Germany", "at": "Austria", "ch": "Switzerland", "nl": "Netherlands", "be": "Belgium", "lu": "Luxembourg", "fr": "France", "es": "Spain", "pt": "Portugal", "it": "Italy", "ie": "Ireland", "gb": "United Kingdom",
    "se": "Sweden", "no": "Norway", "dk": "Denmark", "fi": "Finland", "is": "Iceland", "pl": "Poland", "cz": "Czechia", "sk": "Slovakia", "hu": "Hungary", "ro": "Romania", "bg": "Bulgaria", "gr": "Greece", "hr": "Croatia", "si": "Slovenia",
    "rs": "Serbia", "ee": "Estonia", "lv": "Latvia", "lt": "Lithuania", "ua": "Ukraine", "cy": "Cyprus", "mt": "Malta", "il": "Israel", "ae": "UAE", "sa": "Saudi Arabia", "qa": "Qatar", "eg": "Egypt", "za": "South Africa", "ng": "Nigeria",
    "ke": "Kenya", "ma": "Morocco", "us": "United States", "ca": "Canada", "mx": "Mexico", "br": "Brazil", "ar": "Argentina", "cl": "Chile", "co": "Colombia", "pe": "Peru", "uy": "Uruguay", "in": "India", "cn": "China", "jp": "Japan",
    "kr": "South Korea", "tw": "Taiwan", "hk": "Hong Kong", "sg": "Singapore", "my": "Malaysia", "th": "Thailand", "vn": "Vietnam", "ph": "Philippines", "id": "Indonesia", "au": "Australia", "nz": "New Zealand", "pk": "Pakistan", "bd": "Bangladesh",
}
#: The countries of each region.
_EU = ("at", "be", "bg", "hr", "cy", "cz", "dk", "ee", "fi", "fr", "de", "gr", "hu", "ie", "it", "lv", "lt", "lu", "mt", "nl", "pl", "pt", "ro", "sk", "si", "es", "se")
REGIONS = {
    "eu": _EU,
    "emea": (*_EU, "gb", "ch", "no", "is", "rs", "ua", "tr", "il", "ae", "sa", "qa", "eg", "za", "ng", "ke", "ma"),
    "tr": ("tr",),
    "uk-ie": ("gb", "ie"),
    "dach": ("de", "at", "ch"),
    "nordics": ("se", "no", "dk", "fi", "is"),
    "americas": ("us", "ca", "mx", "br", "ar", "cl", "co", "pe", "uy"),
    "apac": ("in", "cn", "jp", "kr", "tw", "hk", "sg", "my", "th", "vn", "ph", "id", "au", "nz", "pk", "bd"),
}


def regions_of(country: Column) -> Column:
    """The regions that hold a country, in their own order; none for an unknown one."""
    return F.array_compact(F.array(*(F.when(country.isin(*codes), F.lit(name)) for name, codes in REGIONS.items())))


def countries_in(regions) -> list[str]:
    """The union of regions' countries, each once; all known countries where no region is chosen."""
    chosen = [r for r in regions if r in REGIONS]
    return list(dict.fromkeys(c for r in chosen for c in REGIONS[r])) if chosen else list(COUNTRY_NAMES)


def bridge(spark) -> DataFrame:
    """(country, region): a row for each membership; a few hundred rows whatever the data."""
    return spark.createDataFrame([(c, r) for r, codes in REGIONS.items() for c in codes], "country string, region string")
