"""Linear operators with tunable parameters on distributed data, planned by Catalyst."""

from .functions.arrays import as_matrix, cpu, from_matrix, gelu, gpu, rotate_axes, zeros, zeros_like
from .functions.gradients import gather_gradients, grad_input, grad_params, pullback
from .functions.params import from_arrays, generated, init, merge, scale, update
from .functions.render import dot_string, latex_string, plot_operator_graph
from .operators.base import Operator, OperatorError
from .operators.leaves import Diagonal, Fourier, Identity, Matrix, Reduce, Repartition, Restriction, Tensor
from .operators.nodes import Adjoint, Bound, Broadcasted, Compose, Distributed, Kron, broadcasted, compose, composed, kron, kron_of
from .plans.chunks import chunked, matrix_blocks, moved_blocks, rotated_blocks, whole_items
from .plans.cost import complexity, local_complexity
from .plans.distribute import distribute, global_rows, local_diagonal, local_params, local_part, local_rows
from .plans.grid import cumulative_ranges, local_size, range_axes
from .plans.lower import apply, dense_of, long_of, rapply
from .plans.rewrite import Optimizer, merkle_hash, optimize, transforms
from .plans.tiles import generated_tiles, tiled
from .sources.json_codec import from_json, to_json

__all__ = [
    "Adjoint", "Bound", "Broadcasted", "Compose", "Diagonal", "Distributed", "Fourier", "Identity", "Kron", "Matrix", "Operator", "OperatorError", "Optimizer",
    "Reduce", "Repartition", "Restriction", "Tensor", "apply", "as_matrix", "broadcasted", "chunked", "complexity", "compose", "composed", "cpu", "cumulative_ranges", "dense_of", "distribute",
    "dot_string", "from_arrays", "from_json", "from_matrix", "gather_gradients", "gelu", "generated", "generated_tiles", "global_rows", "gpu", "grad_input", "grad_params", "init", "kron", "kron_of", "latex_string",
    "local_complexity", "local_diagonal", "local_params", "local_part", "local_rows", "local_size", "long_of", "matrix_blocks", "merge", "merkle_hash", "moved_blocks", "optimize", "plot_operator_graph", "pullback", "range_axes", "rapply", "rotate_axes", "rotated_blocks", "scale", "tiled", "to_json", "transforms", "update", "whole_items", "zeros", "zeros_like",
]
