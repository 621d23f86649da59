"""Derived columns of manifests: size buckets, subjects, keys, normal forms, labels re-derived from provenance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper edges of the native long side and the names of their buckets, in display order.
BUCKETS = [(341, "<=341"), (512, "342-512"), (768, "513-768"), (1024, "769-1024"), (None, ">1024")]
BUCKETS_3 = [(341, "<=341"), (640, "<=640"), (None, ">640")]

# Patterns of subjects, the first match names the subject.
SUBJECTS = [
    (r"bedroom|lsun-bed|/bed/", "bedroom"),
    (r"church|churces", "church"),
    (r"landscape", "landscape"),
    (r"monet|art_painting|(?<!in)painting", "painting"),
    (r"ffhq|celeb|metfaces|sfhq|face|star_gan|stargan|denoising_diffusion_gan|blond|black_hair|brown_hair|/male|/female|/young", "faces"),
    (r"afhq|/cat/|/dog/|/wild/|imgs_cat|imgs_dog|imgs_wild|horse2zebra|/horse/|/cat$|/dog$|/wild$", "animals"),
    (r"/car/|cityscapes|car-part", "vehicles/street"),
    (r"coco|cc9k|imagenet|imgnet|big_gan|places|ade|/images/|/n0\d+|glide|latentdiff|stable_diffusion|t2i|tt-cc", "general scenes"),
    (r"pro_gan|/pro/", "voc objects"),
]

# Schools of generators.
SCHOOLS = {
    "diffusion": {"ddpm", "ddim", "latent_diffusion", "stable_diffusion", "glide", "palette", "vq_diffusion", "denoising_diffusion_gan", "diffusion_gan"},
    "gan": {"biggan", "big_gan", "stargan", "star_gan", "stylegan", "stylegan1", "stylegan2", "stylegan3", "pro_gan", "projected_gan", "gansformer", "cips", "gau_gan", "cycle_gan", "face_synthetics", "sfhq"},
    "token": {"vqvae", "taming_transformer"},
}

# Sources of real photographs, and routing of generators and sources.
REAL_SOURCES = {"afhq_512", "celebahq_1024", "openimages_1024", "ffhq_1024", "coco_640", "sid_real", "real", "flickr30k_web"}
HOLD_OUT = {"ddpm", "ddim"}
PARTIAL_EDITS = {"sid_tampered", "lama", "mat", "generative_inpainting", "palette"}
TEST_ONLY = HOLD_OUT | PARTIAL_EDITS | {"deepfloyd_if"}
SOURCE_CAPS = {"lsun_bedroom": 3000, "afhq_512": 4000, "celebahq_1024": 1500}


def _edges(value: Column, table: list) -> Column:
    out = None
    for edge, name in table:
        if edge is None:
            return out.otherwise(F.lit(name))
        out = F.when(value <= edge, name) if out is None else out.when(value <= edge, name)
    raise ValueError("the last bucket must be open")


def bucket(long: Column) -> Column:
    """Name of the size bucket; null for a missing or non-positive size."""
    return F.when(long > 0, _edges(long, BUCKETS))


def bucket3(long: Column) -> Column:
    return F.when(long > 0, _edges(long, BUCKETS_3))


def bucket_order(name: Column) -> Column:
    """Position of a bucket's name in display order, from 0."""
    return F.array_position(F.array(*(F.lit(n) for _, n in BUCKETS)), name) - 1


def long_side(w: Column, h: Column) -> Column:
    return F.greatest(w, h)


def source_key(orig: Column, path: Column) -> Column:
    """Identity of the source file: ``orig``, or ``path`` where that is missing or empty."""
    return F.coalesce(F.nullif(orig, F.lit("")), path)


def norm_path(path: Column) -> Column:
    """Forward slashes, without leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", "")


def norm_generator(name: Column) -> Column:
    return F.lower(F.translate(name, "_-", ""))


def subject(source: Column, category: Column, orig: Column) -> Column:
    """Subject named by the first matching pattern, else ``other``."""
    key = F.lower(F.concat_ws("/", F.coalesce(source, F.lit("")), F.coalesce(category, F.lit("")), F.coalesce(orig, F.lit(""))))
    return first_match(key, SUBJECTS)


def first_match(key: Column, rules: list[tuple[str, str]], default: str = "other") -> Column:
    out = None
    for pattern, name in rules:
        out = F.when(key.rlike(pattern), name) if out is None else out.when(key.rlike(pattern), name)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def school(generator: Column) -> Column:
    out = None
    for name, members in SCHOOLS.items():
        hit = generator.isin(*sorted(members))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def provenance(source: Column, orig: Column, target: Column) -> Column:
    """struct(truth, rule): the label that the origin tells, by the first rule that applies; truth is null if none does.

    ``target`` is the label of the external metadata for this file, null where there is none.
    Fixed values: the names of the rules, and the parts of paths that they look for.
    """
    o = F.translate(orig, "\\", "/")
    truth = lambda v, rule: F.struct(F.lit(v).cast("int").alias("truth"), rule.alias("rule"))
    folder = F.when(o.contains("/ext/img/"), F.substring_index(F.substring_index(o, "/ext/img/", -1), "/", 1)).otherwise(source)
    real = folder.isin(*sorted(REAL_SOURCES)) | folder.startswith("real")
    wild = F.when(o.contains("/Images/Real/"), truth(0, F.lit("wildfake:Real folder"))).when(o.contains("_based/"), truth(1, F.lit("wildfake:generator folder"))).otherwise(truth(None, F.lit("wildfake:unresolved")))
    art = F.when(target.isNotNull(), F.struct(target.cast("int").alias("truth"), F.lit("artifact:metadata target").alias("rule"))).otherwise(truth(None, F.lit("artifact:no metadata match")))
    omni = F.when(o.contains("/val/real/") | (source == "omnifake_real"), truth(0, F.lit("omnifake:val/real"))).otherwise(truth(1, F.lit("omnifake:val/<generator>")))
    ext = F.struct(F.when(real, 0).otherwise(1).alias("truth"), F.concat(F.lit("ext:"), folder).alias("rule"))
    return (
        F.when((source == "wildfake") | o.contains("/wildfake/"), wild)
        .when(source.startswith("artifact") | o.contains("/artifact/"), art)
        .when(source.startswith("lsun"), truth(0, F.lit("lsun")))
        .when(source.startswith("omnifake") | o.contains("/omnival/"), omni)
        .when(source.isin(*sorted(REAL_SOURCES)) | o.contains("/ext/img/"), ext)
        .otherwise(truth(None, F.concat(F.lit("unknown source "), source)))
    )


def forbidden_slice(orig: Column) -> Column:
    """Whether a path belongs to a benchmark that training must not see."""
    low = F.lower(orig)
    return low.contains("val2017") | low.contains("dalle3")


def feasible_mask(w: Column, h: Column) -> Column:
    """Whether the short side still has 294 pixels when the long one is scaled to 448."""
    return F.least(w, h) * 448 / F.greatest(w, h) >= 294


def verdict(value: Column, mild: float = 0.55, fail: float = 0.65) -> Column:
    return F.when(value < mild, "CLEAN").when(value <= fail, "MILD").otherwise("FAIL")


# Labels of an external set's classes, names of its models, and parts of paths and sources.
EXTERNAL_CLASSES = {0: (0, "", "sid_real"), 1: (1, "flux_sid", "sid_fake"), 2: (1, "sid_tampered", "sid_tampered")}
EXTERNAL_MODELS = {"DeepFloyd/IF-II-L-v1.0": "deepfloyd_if", "CompVis/stable-diffusion-v1-4": "sd14", "stabilityai/stable-diffusion-2-1-base": "sd21", "stabilityai/stable-diffusion-xl-base-1.0": "sdxl"}
TOPICS = [("afhq", "animal"), ("church", "church"), ("lsun", "church"), ("celeba", "face"), ("ffhq", "face"), ("sfhq", "face"), ("metfaces", "face"), ("landscape", "landscape"), ("coco", "object"), ("imagenet", "object")]
OFFICIAL_SLICE = "/coco2017/val2017/"
INPAINTED = "/glide-in/"


def external_class(code: Column) -> Column:
    """struct(label, generator, source) of an external set's class number; null for others."""
    out = None
    for k, (label, generator, source) in EXTERNAL_CLASSES.items():
        value = F.struct(F.lit(label).alias("label"), F.lit(generator).alias("generator"), F.lit(source).alias("source"))
        out = F.when(code == k, value) if out is None else out.when(code == k, value)
    return out


def external_model(name: Column) -> Column:
    """The short name of a model of an external set; of others, what stands behind the last slash."""
    known = F.create_map(*(F.lit(x) for pair in EXTERNAL_MODELS.items() for x in pair))
    return F.coalesce(known[name], F.substring_index(name, "/", -1))


def named_label(name: Column) -> Column:
    """1 for names of classes that say fake, ai or synthetic, else 0 for those that say real; others fail the query."""
    low = F.lower(name)
    fake = low.contains("fake") | low.contains("ai") | low.contains("synthetic")
    return F.when(fake, 1).when(low.contains("real"), 0).otherwise(F.raise_error(F.concat(F.lit("no label in the name "), F.coalesce(name, F.lit("null")))).cast("int"))


def topic(source: Column) -> Column:
    """Topic of a source: that of the first word that it holds, else ``object``."""
    return first_match(F.lower(source), TOPICS, "object")


def official_slice(orig: Column) -> Column:
    return F.coalesce(orig.contains(OFFICIAL_SLICE), F.lit(False))


def tampered(generator: Column, orig: Column, generators: set[str] = PARTIAL_EDITS) -> Column:
    """Whether a part of a real picture was made anew."""
    return F.coalesce(generator.isin(*sorted(generators)), F.lit(False)) | F.coalesce(orig.contains(INPAINTED), F.lit(False))


def bogus(label: Column, source: Column, generator: Column, bad: set[str], of: str = "wildfake") -> Column:
    """Whether a fake of one source names a generator that is known to be wrong there."""
    return F.coalesce((label == 1) & (source == of) & generator.isin(*sorted(bad)), F.lit(False))


def seen_tag(generator: Column, trained: Column) -> Column:
    """TRAINED if the array ``trained`` of normalised names has the generator, else unseen."""
    return F.when(F.array_contains(trained, norm_generator(generator)), "TRAINED").otherwise("unseen")
