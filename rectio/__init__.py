"""Reading and writing rectangular text with Spark."""

from rectio.functions.locale import DateNames, Locale, date_names_lang, date_names_langs, default_locale, locale
from rectio.operators.generate import (
    gen_character, gen_date, gen_datetime, gen_double, gen_factor, gen_integer, gen_logical, gen_name, gen_number, gen_tbl, gen_time,
)
from rectio.operators.guess import guess_type
from rectio.operators.writer import format_delim, output_column, register_output, write_delim, write_delim_dir, write_lines
from rectio.plans.select import contains, ends_with, everything, last_col, matches, num_range, one_of, span, starts_with
from rectio.plans.spec import (
    ColSpec, MismatchedColumnName, as_col_spec, col_big_integer, col_character, col_date, col_datetime, col_double, col_factor, col_guess, col_integer,
    col_logical, col_number, col_skip, col_time, cols, cols_condense, cols_only,
)
from rectio.sources.delimited import ParseIssue, RectFrame, read_delim
from rectio.sources.fixed import fwf_cols, fwf_empty, fwf_positions, fwf_widths, read_fwf, read_lines
from rectio.sources.staging import I
from rectio.streaming.delimited import read_stream

__all__ = [name for name in dir() if not name.startswith("_")]
