"""Built-in tasks as Column functions.

``BUILTINS`` maps a task name to a function of Columns.  A function gives back one Column, or a
dict of Columns by port for tasks with several outputs.
"""

import builtins
import keyword

from skein.functions import lists, logic, numbers, reductions, text

BUILTINS = {**numbers.TASKS, **logic.TASKS, **text.TASKS, **lists.TASKS, **reductions.TASKS}


def plain_name(task: str) -> str:
    """Name of a built-in without ``builtins.``, and without a prefix that keeps it apart from Python's own names (``x_abs`` is ``abs``).

    Only names that Python itself has are taken for prefixed ones: ``my_add`` is not ``add``.
    """
    name = task.removeprefix("builtins.")
    if name not in BUILTINS and "." not in name and (rest := name.partition("_")[2]) in BUILTINS and (hasattr(builtins, rest) or keyword.iskeyword(rest)):
        return rest
    return name
