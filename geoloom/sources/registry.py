"""The sources that scenes come from: one row each. A source is a family of payloads with a collection's parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name, family, provider, collection, satellite, kind, metres a pixel, whether dates are sent; - is none.
SOURCES = """
sentinel1 stac planetary-computer sentinel-1-rtc sentinel1 sar 10.0 yes
sentinel2 stac planetary-computer sentinel-2-l2a sentinel2 optical 10.0 yes
landsat8 stac planetary-computer landsat-c2-l2 landsat8 optical 30.0 yes
landsat9 stac planetary-computer landsat-c2-l2 landsat9 optical 30.0 yes
landsat_c2_l1 stac planetary-computer landsat-c2-l1 landsat optical 30.0 yes
modis_active_fire cmr earthdata MOD14A1 modis thermal 1000.0 yes
modis_land_cover cmr earthdata MCD12Q1 modis landcover 500.0 yes
modis_surface cmr earthdata MOD09GA modis optical 500.0 yes
modis_vegetation cmr earthdata MOD13A2 modis optical 1000.0 yes
hls_landsat stac planetary-computer hls2-l30 landsat optical 30.0 yes
hls_sentinel stac planetary-computer hls2-s30 sentinel2 optical 30.0 yes
naip stac planetary-computer naip naip optical 1.0 yes
cop_dem stac planetary-computer cop-dem-glo-30 copernicus dem 30.0 no
cop_dem_90 stac planetary-computer cop-dem-glo-90 copernicus dem 90.0 no
nasadem stac planetary-computer nasadem nasa dem 30.0 no
aster stac planetary-computer aster-l1t aster optical 15.0 yes
alos_palsar stac planetary-computer alos-palsar-mosaic alos sar 25.0 no
alos_fnf stac planetary-computer alos-fnf-mosaic alos landcover 25.0 no
pc_modis_14a1 stac planetary-computer modis-14A1-061 modis thermal 1000.0 yes
pc_modis_13q1 stac planetary-computer modis-13Q1-061 modis optical 250.0 yes
pc_modis_09a1 stac planetary-computer modis-09A1-061 modis optical 500.0 yes
goes_cmi stac planetary-computer goes-cmi goes optical 2000.0 yes
esa_worldcover stac planetary-computer esa-worldcover worldcover landcover 10.0 no
io_lulc_annual stac planetary-computer io-lulc-annual-v02 lulc landcover 10.0 no
mrms_qpe_24h stac planetary-computer noaa-mrms-qpe-24h-pass2 mrms precipitation 1000.0 yes
earthsearch_sentinel1_grd stac earth-search sentinel-1-grd sentinel1 sar 10.0 yes
earthsearch_sentinel2_l2a stac earth-search sentinel-2-l2a sentinel2 optical 10.0 yes
cdse_sentinel3_olci stac cdse sentinel-3-olci-1-efr-ntc sentinel3 optical 300.0 yes
cdse_sentinel3_slstr_lst stac cdse sentinel-3-sl-2-lst-ntc sentinel3 thermal 1000.0 yes
cdse_sentinel3_slstr_frp stac cdse sentinel-3-sl-2-frp-ntc sentinel3 thermal 1000.0 yes
cdse_sentinel3_sral stac cdse sentinel-3-sr-2-wat-ntc sentinel3 altimetry - yes
cdse_sentinel5p_no2 stac cdse sentinel-5p-l2-no2-offl sentinel5p atmosphere 5500.0 yes
cdse_sentinel5p_ch4 stac cdse sentinel-5p-l2-ch4-offl sentinel5p atmosphere 5500.0 yes
cdse_sentinel5p_co stac cdse sentinel-5p-l2-co-offl sentinel5p atmosphere 5500.0 yes
cdse_clms_burnt_area stac cdse clms_ba_global_300m_daily_v4_cog clms detection 300.0 yes
gedi stac earthdata GEDI02_A_002 gedi lidar 25.0 yes
viirs_vnp09ga stac earthdata VNP09GA.v002 viirs optical 500.0 yes
icesat2_atl03 stac earthdata ATL03_007 icesat2 lidar - yes
smap_l3 stac earthdata SPL3SMP_E_006 smap atmosphere 9000.0 yes
dea_s2_ard stac digital-earth ga_s2am_ard_3 sentinel2 optical 10.0 yes
dea_s2b_ard stac digital-earth ga_s2bm_ard_3 sentinel2 optical 10.0 yes
deafrica_s2 stac digital-earth s2_l2a sentinel2 optical 10.0 yes
cbers4_mux stac inpe CB4-MUX-L4-SR-1 cbers4 optical 20.0 yes
amazonia1_wfi stac inpe AMZ1-WFI-L4-SR-1 amazonia1 optical 64.0 yes
maxar_opendata tree maxar - maxar optical - yes
firms_viirs firms firms VIIRS_SNPP_NRT viirs detection 375.0 yes
firms_viirs_noaa20 firms firms VIIRS_NOAA20_NRT viirs detection 375.0 yes
firms_viirs_noaa21 firms firms VIIRS_NOAA21_NRT viirs detection 375.0 yes
firms_modis firms firms MODIS_NRT modis detection 1000.0 yes
firms_landsat firms firms LANDSAT_NRT landsat detection 30.0 yes
fldas grid earthdata FLDAS_NOAH01_C_GL_M fldas landsurface 11132.0 yes
gibs_modis_truecolor gibs gibs MODIS_Terra_CorrectedReflectance_TrueColor modis browse - yes
gibs_viirs_truecolor gibs gibs VIIRS_SNPP_CorrectedReflectance_TrueColor viirs browse - yes
gibs_aqua_truecolor gibs gibs MODIS_Aqua_CorrectedReflectance_TrueColor modis browse - yes
gibs_night_lights gibs gibs VIIRS_SNPP_DayNightBand_At_Sensor_Radiance viirs browse - yes
gibs_black_marble gibs gibs VIIRS_Black_Marble viirs browse - yes
gibs_flood_3day gibs gibs MODIS_Combined_Flood_3-Day modis browse - yes
gibs_snow gibs gibs MODIS_Terra_NDSI_Snow_Cover modis browse - yes
gibs_thermal gibs gibs VIIRS_NOAA20_Thermal_Anomalies_375m_All viirs thermal - yes
goes listing noaa - goes optical - yes
himawari listing noaa - himawari optical - yes
"""
SCHEMA = "source string, family string, provider string, collection string, satellite string, kind string, gsd_m double, sends_dates boolean"


def rows() -> list[tuple]:
    found = []
    for line in SOURCES.split("\n"):
        if line:
            name, family, provider, collection, satellite, kind, gsd, dates = line.split(" ")
            found.append((name, family, provider, None if collection == "-" else collection, satellite, kind, None if gsd == "-" else float(gsd), dates == "yes"))
    return found


def sources(spark: SparkSession, *names: str) -> DataFrame:
    """The table of all sources, or of those named; an unknown name is an error."""
    every = rows()
    unknown = set(names) - {r[0] for r in every}
    if unknown:
        raise KeyError(f"unknown sources: {sorted(unknown)}")
    return spark.createDataFrame([r for r in every if not names or r[0] in names], SCHEMA)


def resolved(spark: SparkSession, satellite: str, kind: str | None = None) -> DataFrame:
    """Sources of a satellite, and of a kind, by names as people write them."""
    from pyspark.sql import functions as F

    from geoloom.functions.text import token

    known = sources(spark)
    hits = known.filter(token(F.col("satellite")) == token(F.lit(satellite)))
    return hits if kind is None else hits.filter(token(F.col("kind")) == token(F.lit(kind)))
