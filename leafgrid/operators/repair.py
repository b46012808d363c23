"""Training data from corrected annotations: prompts, samples, ground-truth exports and the repair of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid.functions import jsonx as J
from leafgrid.functions import text as T
from leafgrid.operators import export as X
from leafgrid.operators.blocks import described, unit_box
from leafgrid.operators.hierarchy import page_outlines


def training_user(page: Column, outline: Column | None = None) -> Column:
    """User text of a page struct (page_id, width, height, model_width, model_height), followed by the outline if there is one."""
    size = lambda name: F.coalesce(F.nullif(page["model_" + name], F.lit(0)), page[name], F.lit(0))
    text = T.page_text(F.coalesce(page["page_id"], F.lit(0)), size("width"), size("height"))
    return text if outline is None else F.concat_ws("\n\n", text, T.filled(outline))


def training_system(stored: Column, template_id: Column, builtin: str, refresh: bool = False, default_id: str = "default_template_1") -> Column:
    """System text of a page: the stored one, or the built-in prompt where a refresh is asked for and the job used the default template."""
    kept = F.coalesce(stored, F.lit(""))
    return F.when(F.coalesce(template_id, F.lit("")) == default_id, F.lit(builtin)).otherwise(kept) if refresh else kept


def annotation_samples(pages: DataFrame, style: str) -> DataFrame:
    """Samples straight from annotated pages (doc, page_id, image, system, user, blocks); pages without image or blocks are left out."""
    usable = pages.where((F.coalesce(F.trim("image"), F.lit("")) != "") & (F.size("blocks") > 0))
    ref = X.image_ref(F.col("doc").cast("string"), F.col("page_id"), F.lit(".png"))
    answer = J.compact(F.struct(ref.alias("image_path"), "blocks"))
    return X.samples(usable.select("doc", "page_id", "image", "system", "user", answer.alias("assistant")), style)


def truth_samples(blocks: DataFrame, system: str) -> DataFrame:
    """One sample per page with usable blocks (doc, page_id, ord, block_type, level, x1, text, b; null b: not usable).

    The outline of a page comes from the usable blocks of the pages before it only.
    """
    usable = blocks.where("b is not null")
    answers = X.page_answers(usable.select("doc", "page_id", "ord", "b"))
    both = answers.join(page_outlines(usable.drop("b")).select("doc", "page_id", "outline"), ["doc", "page_id"])
    image = F.format_string("images/%s/page_%03d.png", F.col("doc").cast("string"), F.col("page_id"))
    user = F.concat(F.lit("<image>\n"), T.page_text(F.col("page_id"), F.lit(100), F.lit(200)), F.lit("\n\n"), F.col("outline"))
    answer = J.compact(F.struct(image.alias("image_path"), "blocks"))
    return both.select("doc", "page_id", F.lit(system).alias("system"), user.alias("user"), answer.alias("assistant"), image.alias("image"), F.size("blocks").alias("n_blocks"))


def repair_plan(jobs: DataFrame, versions: DataFrame, include_missing: bool = False, skip_qa: bool = False, dry_run: bool = False) -> DataFrame:
    """(job_id, status, reason, training, qa, version): what a repair does to each job.

    ``jobs`` has job_id, has_training, has_qa; ``versions`` the active annotation of each job (job_id, version). A job is skipped if it has no
    file to rebuild or no annotation.
    """
    training = F.col("has_training") | F.lit(include_missing)
    qa = F.col("has_qa") & F.lit(not skip_qa)
    both = jobs.join(versions.select("job_id", "version"), "job_id", "left").select("job_id", training.alias("training"), qa.alias("qa"), "version")
    reason = F.when(~F.col("training") & ~F.col("qa"), "no file to repair").when(F.col("version").isNull(), "annotation not found")
    status = F.when(reason.isNotNull(), "skipped").otherwise("would_repair" if dry_run else "repaired")
    done = reason.isNull()
    return both.select("job_id", status.alias("status"), reason.alias("reason"), (F.col("training") & done).alias("training"), (F.col("qa") & done).alias("qa"), F.when(done, F.col("version")).alias("version"))


def repaired_jobs(plan: DataFrame, qa: DataFrame, pages: DataFrame, outlines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(Q&A rows, training lines) of the jobs that a plan repairs; ``doc`` is the job. Other jobs' Q&A rows stay as they are."""
    mine = lambda rows, what: rows.join(plan.where((F.col("status") == "repaired") & F.col(what)).select(F.col("job_id").alias("doc")), "doc", "left_semi")
    return X.refreshed_answers(qa, mine(pages, "qa"), outlines), X.training_lines(mine(pages, "training"), outlines)


def fallback_block(b: Column, page_id: Column, index: Column) -> Column:
    """A job's block as an annotation block, for a job that was never annotated."""
    label = T.block_type(F.coalesce(T.filled(b["label"]), b["block_type"]))
    own = F.coalesce(T.filled(b["id"]), F.format_string("p%03d_b%03d", page_id, index))
    return F.struct(
        own.alias("id"), F.coalesce(b["bbox"], unit_box()).alias("bbox"), label.alias("label"), F.coalesce(b["text"], F.lit("")).alias("text"), described(label, b["description"]).alias("description"),
        F.coalesce(b["page_id"], page_id).alias("page_id"), F.lit("model").alias("source"), F.lit(False).alias("modified"), T.filled(b["level"]).alias("level"),
    )
